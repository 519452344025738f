"""Queries over the program that is derived from the star schema."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from weft.operators import build, graph
from weft.plans.registry import query
from weft.sources import program
from weft.sources.program import LOOPS_SQL, SQL


def _interesting(p: program.Program) -> DataFrame:
    return p.nodes.where("node % 9 <> 4").select("node")


def _safe(p: program.Program) -> DataFrame:
    """Objects 0 to 3 count as unique."""
    return build.safe_locks(p, p.points_to.where("obj < 4").select("obj").distinct())


_PARTS = f"""{SQL},
    sym AS (SELECT node, bb, idx, kind, ref, throws, concat_ws('.', node, bb, idx) AS s, concat_ws('.', node, bb, idx + 1) AS t FROM instr),
    interesting AS (SELECT node FROM nodes WHERE node % 9 <> 4),
    recv AS (SELECT node AS target, obj FROM points_to WHERE var = 1),
    used AS (SELECT node, obj, 'class' AS origin FROM nodes JOIN class_obj USING (class) WHERE is_sync AND is_static
        UNION SELECT node, obj, 'object' FROM nodes JOIN recv ON node = target WHERE is_sync AND NOT is_static
        UNION SELECT i.node, p.obj, 'monitor' FROM instr i JOIN points_to p ON p.node = i.node AND p.var = i.ref WHERE kind = 'menter'),
    calls AS (SELECT s.*, target FROM sym s JOIN call_targets c USING (node, bb, idx)),
    sites AS (SELECT node, obj FROM used WHERE origin = 'monitor' UNION SELECT c.node, obj FROM calls c JOIN nodes n ON n.node = c.target JOIN class_obj o ON o.class = n.class WHERE is_sync AND is_static
        UNION SELECT c.node, r.obj FROM calls c JOIN nodes n ON n.node = c.target JOIN recv r ON r.target = c.target WHERE is_sync AND NOT is_static),
    safe AS (SELECT DISTINCT node, obj FROM sites WHERE (obj < 4 OR obj >= 100) AND node IN (SELECT node FROM nodes WHERE loader = 'Application')
        AND NOT EXISTS (SELECT 1 FROM waits w WHERE w.node = sites.node AND w.obj = sites.obj))"""
_NONE = "NULL::INTEGER AS g2, NULL::VARCHAR AS s2, NULL::BIGINT AS lock"


@query(
    f"""WITH {_PARTS},
    inside AS (SELECT c.*, n.class, n.is_static, n.is_sync FROM calls c JOIN nodes n ON n.node = c.target WHERE target IN (SELECT node FROM interesting)),
    sync AS (SELECT i.*, o.obj FROM inside i JOIN class_obj o USING (class) WHERE is_sync AND is_static
        UNION ALL SELECT i.*, r.obj FROM inside i LEFT JOIN recv r ON r.target = i.target WHERE is_sync AND NOT is_static),
    locked AS (SELECT y.*, CASE WHEN EXISTS (SELECT 1 FROM safe f WHERE f.node = y.node AND f.obj = y.obj) THEN obj END AS lock FROM sync y)
    SELECT 'base' AS kind, 0 AS g, s, 'call' AS action, e AS g1, t AS s1, {_NONE} FROM sym, (VALUES (0), (1)) v(e) WHERE kind = 'invoke' AND (node, bb, idx) NOT IN (SELECT (node, bb, idx) FROM call_targets)
    UNION ALL SELECT DISTINCT 'base', 0, s, 'throw', 1, t, NULL, NULL, NULL FROM calls
    UNION ALL SELECT DISTINCT 'base', 0, s, 'skip', 0, t, NULL, NULL, NULL FROM calls WHERE target NOT IN (SELECT node FROM interesting)
    UNION ALL SELECT 'push', 0, s, 'call', 0, concat_ws('.', target, 0, 0), NULL, t, NULL FROM inside WHERE NOT is_sync
    UNION ALL SELECT 'push', 0, s, CASE WHEN obj IS NULL THEN 'call' WHEN lock IS NULL THEN 'skip enter' ELSE 'enter' END, 0, concat_ws('.', target, 0, 0), NULL, t, lock FROM locked"""
)
def rules_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = program.derived(spark, sf_dir)
    return build.invoke_rules(p, _interesting(p), _safe(p))


_EXITS = """exits AS (SELECT node, bb, idx, exit_bb, exit_idx, row_number() OVER (PARTITION BY node, bb, idx ORDER BY exit_bb, exit_idx) - 1 AS num FROM (
        SELECT DISTINCT w.node, w.ebb AS bb, w.eidx AS idx, w.bb AS exit_bb, w.idx AS exit_idx FROM w JOIN instr i ON i.node = w.node AND i.bb = w.bb AND i.idx = w.idx WHERE w.depth = 0 AND i.kind = 'mexit'))"""
_WALK = """sizes AS (SELECT b.node, b.bb, count(i.idx) AS size FROM blocks b LEFT JOIN instr i ON i.node = b.node AND i.bb = b.bb GROUP BY ALL),
    nxt AS (SELECT node, bb, idx, bb AS bb2, idx + 1 AS idx2, CASE kind WHEN 'menter' THEN 1 WHEN 'mexit' THEN -1 ELSE 0 END AS m FROM instr
        UNION SELECT s.node, s.bb, z.size, s.bb2, 0, 0 FROM succ s JOIN sizes z USING (node, bb) WHERE NOT exceptional),
    w(node, ebb, eidx, bb, idx, depth) AS (SELECT node, bb, idx, bb, idx + 1, 0 FROM instr WHERE kind = 'menter'
        UNION SELECT w.node, w.ebb, w.eidx, n.bb2, n.idx2, w.depth + n.m FROM w JOIN nxt n ON n.node = w.node AND n.bb = w.bb AND n.idx = w.idx WHERE w.depth + n.m >= 0)"""


@query(f"WITH RECURSIVE {SQL}, {_WALK}, {_EXITS} SELECT * FROM exits")
def monitor_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.monitor_exits(program.derived(spark, sf_dir))


@query(
    f"""WITH {_PARTS}, exits AS (SELECT node, bb, idx, bb AS exit_bb, idx + 1 AS exit_idx, 0 AS num FROM instr WHERE kind = 'menter'),
    objects AS (SELECT m.node, m.bb, m.idx, m.s, m.t, p.obj, CASE WHEN EXISTS (SELECT 1 FROM safe f WHERE f.node = m.node AND f.obj = p.obj) AND count(p.obj) OVER (PARTITION BY m.s) = 1 THEN p.obj END AS lock
        FROM sym m LEFT JOIN points_to p ON p.node = m.node AND p.var = m.ref WHERE kind = 'menter')
    SELECT 'push' AS kind, 0 AS g, s, CASE WHEN lock IS NULL THEN 'skip enter' ELSE 'enter' END AS action, 0 AS g1, t AS s1, NULL::INTEGER AS g2, concat_ws('.', node, bb, -1) AS s2, lock FROM objects
    UNION ALL SELECT 'pop', 0, concat_ws('.', node, exit_bb, exit_idx), 'exit', 2 + num, NULL, NULL, NULL, NULL FROM exits
    UNION ALL SELECT 'base', 2 + num, concat_ws('.', node, bb, -1), 'none', 0, concat_ws('.', node, exit_bb, exit_idx + 1), NULL, NULL, NULL FROM exits
    UNION ALL SELECT 'base', 0, s, 'throw', 1, t, NULL, NULL, NULL FROM sym WHERE kind = 'mexit'"""
)
def rules_of_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only monitors with one object are locks here; each is left behind its first instruction."""
    p = program.derived(spark, sf_dir)
    exits = p.instr.where("kind = 'menter'").select("node", "bb", "idx", F.col("bb").alias("exit_bb"), (F.col("idx") + 1).alias("exit_idx"), F.lit(0).alias("num"))
    return build.monitor_rules(p, exits, _safe(p), many=False)


@query(
    f"""WITH {_PARTS}, sizes AS (SELECT b.node, b.bb, count(i.idx) AS size FROM blocks b LEFT JOIN instr i ON i.node = b.node AND i.bb = b.bb GROUP BY ALL)
    SELECT 'base' AS kind, 0 AS g, s, kind AS action, 0 AS g1, t AS s1, {_NONE} FROM sym WHERE kind NOT IN ('invoke', 'menter', 'mexit')
    UNION ALL SELECT 'base', 0, s, 'throw', 1, t, NULL, NULL, NULL FROM sym WHERE kind NOT IN ('invoke', 'menter', 'mexit') AND throws
    UNION ALL SELECT 'base', CASE WHEN exceptional THEN 1 ELSE 0 END, concat_ws('.', s.node, s.bb, size), CASE WHEN exceptional THEN concat('catch ', ord) ELSE 'none' END,
        CASE WHEN exceptional AND NOT b.is_catch THEN 1 ELSE 0 END, concat_ws('.', s.node, bb2, 0), NULL, NULL, NULL
        FROM succ s JOIN sizes z ON z.node = s.node AND z.bb = s.bb JOIN blocks b ON b.node = s.node AND b.bb = s.bb2"""
)
def rules_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = program.derived(spark, sf_dir)
    return build.plain_rules(p).unionByName(build.block_rules(p))


@query(
    f"""WITH {_PARTS}, ends AS (SELECT node, bb FROM blocks WHERE is_exit),
    held AS (SELECT node, bb, NULL::BIGINT AS obj FROM ends JOIN nodes USING (node) WHERE NOT is_sync
        UNION ALL SELECT node, bb, obj FROM ends JOIN nodes USING (node) JOIN class_obj USING (class) WHERE is_sync AND is_static
        UNION ALL SELECT e.node, bb, obj FROM ends e JOIN nodes n USING (node) LEFT JOIN recv ON target = e.node WHERE is_sync AND NOT is_static),
    started AS (SELECT DISTINCT node, target FROM call_targets WHERE node IN (SELECT node FROM nodes WHERE is_thread_start))
    SELECT 'pop' AS kind, g, concat_ws('.', node, bb, 0) AS s, CASE WHEN obj IS NULL THEN 'return' ELSE concat('exit ', obj) END AS action, g AS g1, NULL::VARCHAR AS s1, {_NONE} FROM held, (VALUES (0), (1)) v(g)
    UNION ALL SELECT 'spawn', 0, concat_ws('.', node, 0, 0), CASE e WHEN 0 THEN 'spawn' ELSE 'throw' END, e, concat_ws('.', node, 1, 0), 0, concat_ws('.', target, 0, 0), NULL FROM started, (VALUES (0), (1)) v(e)
    UNION ALL SELECT 'base', 0, concat_ws('.', node, 0, 0), 'throw', 1, concat_ws('.', node, 1, 0), NULL, NULL, NULL FROM started"""
)
def rules_of_ends_and_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = program.derived(spark, sf_dir)
    ends = p.blocks.where("is_exit").select("node", "bb")
    return build.return_rules(p, ends).unionByName(build.start_rules(p, p.nodes.where("is_thread_start")))


@query(f"WITH {_PARTS} SELECT DISTINCT node, obj, origin FROM used")
def locks_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.locks_used(program.derived(spark, sf_dir))


@query(f"WITH {_PARTS} SELECT obj, count(DISTINCT node) AS n FROM used GROUP BY obj")
def lock_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.lock_users(program.derived(spark, sf_dir))


@query(f"WITH {_PARTS} SELECT node, obj FROM safe")
def safe_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _safe(program.derived(spark, sf_dir))


@query(f"WITH {SQL} SELECT node AS src, target AS dst, count(*) AS n_sites FROM call_targets GROUP BY ALL")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.call_edges(program.derived(spark, sf_dir))


_ONCE = f"""{LOOPS_SQL}, e AS (SELECT node AS x, target AS y, count(*) AS n FROM call_targets GROUP BY ALL),
    r(x) AS (SELECT 0::BIGINT UNION SELECT y FROM r JOIN e USING (x)),
    many0 AS (SELECT y AS x FROM e WHERE x IN (SELECT x FROM r) GROUP BY y HAVING sum(n) > 1 OR y = 0
        UNION SELECT target FROM call_targets JOIN cyclic USING (node, bb) WHERE node IN (SELECT x FROM r)),
    many(x) AS (SELECT x FROM many0 UNION SELECT y FROM many JOIN e USING (x))"""


def _looped(spark: SparkSession, sf_dir: str) -> program.Program:
    return program.with_loops(program.derived(spark, sf_dir), spark, sf_dir)


def _executed(p: program.Program, cycles: DataFrame, spark: SparkSession) -> DataFrame:
    """x, many: nodes that calls reach from node 0, and whether they may run more than once."""
    edges = build.call_edges(p).select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("n_sites").alias("n"))
    looped = build.looped_calls(p, cycles).withColumnsRenamed({"src": "x", "dst": "y"})
    start = spark.range(1).select(F.col("id").alias("x"))
    return graph.executed(edges, start, looped)


@query(f"WITH RECURSIVE {SQL}, {LOOPS_SQL} SELECT node, bb FROM cyclic")
def flow_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in cycles of their method, where the derived program has ways back."""
    return build.flow_cycles(_looped(spark, sf_dir))


@query(f"WITH RECURSIVE {SQL}, {_ONCE} SELECT x, x IN (SELECT x FROM many) AS many FROM r")
def call_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the call graph that run at most once: call sites counted, those in cycles as many."""
    p = _looped(spark, sf_dir)
    return _executed(p, build.flow_cycles(p), spark)


@query(
    f"""WITH RECURSIVE {SQL}, {_ONCE}
    SELECT node, bb, idx FROM instr WHERE kind = 'new' AND node IN (SELECT x FROM r) AND node NOT IN (SELECT x FROM many) AND (node, bb) NOT IN (SELECT (node, bb) FROM cyclic)"""
)
def unique_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites outside cycles, in nodes that run once."""
    p = _looped(spark, sf_dir)
    cycles = build.flow_cycles(p)
    once = _executed(p, cycles, spark).where("not many").select(F.col("x").alias("node"))
    return build.unique_sites(p, once, cycles)


@query(
    f"""WITH RECURSIVE {_PARTS}, e AS (SELECT DISTINCT node AS x, target AS y FROM call_targets),
    b(x) AS (SELECT node FROM nodes WHERE node % 50 = 7 UNION SELECT e.x FROM b JOIN e ON e.y = b.x),
    sh AS (SELECT DISTINCT obj FROM used WHERE node IN (SELECT x FROM b))
    SELECT x AS node FROM b UNION SELECT node FROM used WHERE obj IN (SELECT obj FROM sh)"""
)
def lock_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = program.derived(spark, sf_dir)
    return build.lock_relevant(p, p.nodes.where("node % 50 = 7").select("node"))


_ACCESS = "acc AS (SELECT i.node, i.bb, i.idx, i.kind, i.field, i.throws, p.obj FROM instr i JOIN points_to p ON p.node = i.node AND p.var = i.ref WHERE i.kind IN ('get', 'put'))"


@query(f"WITH {SQL}, {_ACCESS} SELECT node, bb, idx, kind, field, obj FROM acc")
def field_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.accesses(program.derived(spark, sf_dir))


@query(f"WITH {SQL}, {_ACCESS} SELECT field, array_to_string(list_sort(list_distinct(list(obj))), ',') AS objects, count(*) FILTER (kind = 'get') AS reads, count(*) FILTER (kind = 'put') AS writes FROM acc GROUP BY field")
def field_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.field_objects(program.derived(spark, sf_dir))


@query(
    f"""WITH {SQL}, {_ACCESS} SELECT field, obj, (count(*) FILTER (kind = 'put'))::BIGINT AS writes, (count(*) FILTER (kind = 'get'))::BIGINT AS reads, count(DISTINCT node) AS nodes
    FROM acc GROUP BY field, obj HAVING count(DISTINCT node) > 1 AND count(*) FILTER (kind = 'put') > 0"""
)
def shared_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.shared_objects(program.derived(spark, sf_dir))


@query(
    f"""WITH {SQL}, {_ACCESS} SELECT node, bb, idx, CASE WHEN any_value(field) = 2 AND count(*) = 1 AND min(obj) = 3 THEN
        CASE WHEN any_value(kind) = 'put' THEN 'write' WHEN NOT any_value(throws) THEN 'read' ELSE 'none' END ELSE 'none' END AS annot FROM acc GROUP BY node, bb, idx"""
)
def access_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.access_annotations(program.derived(spark, sf_dir), 2, 3)


@query(f"WITH {SQL} SELECT node, (row_number() OVER (PARTITION BY node ORDER BY bb, idx) - 1)::INTEGER AS number, bb, idx::INTEGER AS idx FROM instr")
def program_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.program_points(program.derived(spark, sf_dir))


@query(f"WITH {SQL} SELECT concat_ws('.', node, 0, 0) AS s FROM nodes WHERE class = 3")
def method_entry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.entry_set(program.derived(spark, sf_dir), 3)


@query(f"WITH {SQL} SELECT kind, count(*) AS n FROM instr WHERE throws GROUP BY kind")
def exception_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.exceptions(program.derived(spark, sf_dir))


@query(
    f"""WITH {_PARTS} SELECT DISTINCT 'base' AS kind, 0 AS g, s, '0' AS action, e AS g1, t AS s1, {_NONE} FROM sym, (VALUES (0), (1)) v(e)
    WHERE kind NOT IN ('invoke', 'menter', 'mexit') AND (e = 0 OR throws)"""
)
def rules_without_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.without_actions(build.plain_rules(program.derived(spark, sf_dir)))


@query(
    """SELECT concat_ws(' ', kind, src, snk, proc, ret) AS edge, * FROM (
        SELECT DISTINCT 'base' AS kind, concat('0:', node, '.', idx) AS src, concat('0:', node, '.', idx + 1) AS snk, NULL::VARCHAR AS proc, NULL::VARCHAR AS ret FROM i WHERE kind <> 'invoke'
        UNION SELECT 'call', concat('0:', node, '.', idx), concat(r, ':', node, '.', idx + 1), concat('0:', ref, '.0'), r FROM i, (VALUES ('0'), ('1')) v(r) WHERE kind = 'invoke')""".join(
        [f"WITH {SQL}, i AS (SELECT * FROM instr) ", ""]
    )
)
def flow_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions as rules of one control state, calls of the procedure named by their variable,
    which return in state 0 or 1."""
    p = program.derived(spark, sf_dir)
    here, after = F.concat_ws(".", "node", "idx"), F.concat_ws(".", F.col("node"), F.col("idx") + 1)
    none, zero = F.lit(None).cast("string"), F.lit(0)
    kind = F.when(F.col("kind") == "invoke", "push").otherwise("base")
    callee = F.when(F.col("kind") == "invoke", F.concat(F.col("ref").cast("string"), F.lit(".0"))).otherwise(after)
    rules = p.instr.select(kind.alias("kind"), zero.alias("g"), here.alias("s"), zero.alias("g1"), callee.alias("s1"), zero.alias("g2"), F.when(F.col("kind") == "invoke", after).alias("s2"))
    pops = spark.range(2).select(F.lit("pop").alias("kind"), zero.alias("g"), F.lit("end").alias("s"), F.col("id").cast("int").alias("g1"), none.alias("s1"), zero.alias("g2"), none.alias("s2"))
    return build.flow_edges(rules.unionByName(pops))


@query(f"WITH {SQL} SELECT concat('  \"', node, '\" -> \"', target, '\" [label=\"', count(*), '\"];') AS line FROM call_targets GROUP BY node, target")
def call_graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.graph_lines(build.call_edges(program.derived(spark, sf_dir)))
