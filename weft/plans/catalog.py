"""The queries over the fixture tables, with the SQL each is compared with."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from weft.operators import conflict, graph, locks, status, strata
from weft.plans import networks
from weft.plans.registry import ORACLES, QUERIES, query
from weft.sources import rules as source
from weft.sources.rules import DERIVED_SQL, EDGES_SQL

FLAGSHIP = "two_set_conflict"


def _start(spark: SparkSession, name: str = "x") -> DataFrame:
    return spark.range(1).select(F.lit(source.INITIAL).cast("bigint").alias(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"WITH {DERIVED_SQL} SELECT s, s1 FROM rules WHERE kind = 'base'")
def dpn_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.derived(spark, sf_dir).where("kind = 'base'").select("s", "s1")


@query(f"WITH {DERIVED_SQL} SELECT s, s1 AS callee, s2 AS ret, coalesce(lock, -1) AS lock FROM rules WHERE kind = 'push'")
def dpn_rules_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    lock = F.coalesce("lock", F.lit(-1).cast("bigint")).alias("lock")
    return source.derived(spark, sf_dir).where("kind = 'push'").select("s", F.col("s1").alias("callee"), F.col("s2").alias("ret"), lock)


@query(f"WITH {DERIVED_SQL} SELECT s FROM rules WHERE kind = 'pop'")
def dpn_rules_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.derived(spark, sf_dir).where("kind = 'pop'").select("s")


@query(f"WITH {DERIVED_SQL} SELECT s, s1 AS rest, s2 AS spawned FROM rules WHERE kind = 'spawn'")
def dpn_rules_spawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.derived(spark, sf_dir).where("kind = 'spawn'").select("s", F.col("s1").alias("rest"), F.col("s2").alias("spawned"))


@query(f"WITH {DERIVED_SQL} SELECT s FROM rules UNION SELECT s1 FROM rules WHERE s1 IS NOT NULL UNION SELECT s2 FROM rules WHERE s2 IS NOT NULL")
def dpn_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.derived(spark, sf_dir).select(F.explode(F.array("s", "s1", "s2")).alias("s")).where("s is not null").distinct()


@query(f"WITH {DERIVED_SQL} SELECT kind, count(*) AS n, count(lock) AS locked FROM rules GROUP BY kind")
def dpn_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.derived(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count("lock").alias("locked"))


@query(f"WITH {DERIVED_SQL} SELECT lock, dense_rank() OVER (ORDER BY lock) - 1 AS number FROM (SELECT DISTINCT lock FROM rules WHERE lock IS NOT NULL)")
def rule_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks (at most 8 by the encoding) numbered in the order of their terms."""
    names = source.derived(spark, sf_dir).where("lock is not null").select("lock").distinct()
    return names.select("lock", (F.dense_rank().over(Window.orderBy("lock")) - 1).cast("bigint").alias("number"))


@query(
    f"""WITH {DERIVED_SQL}
    SELECT 'nil' AS node, s, NULL::BIGINT AS child1, NULL::BIGINT AS child2, 0 AS term FROM (SELECT DISTINCT s FROM rules)
    UNION ALL SELECT 'ret', s, NULL, NULL, 1 FROM rules WHERE kind = 'pop'
    UNION ALL SELECT 'base', s, s1, NULL, -1 FROM rules WHERE kind = 'base'
    UNION ALL SELECT CASE WHEN lock IS NULL THEN 'call1' ELSE 'acq' END, s, s1, NULL, 0 FROM rules WHERE kind = 'push'
    UNION ALL SELECT CASE WHEN lock IS NULL THEN 'call2' ELSE 'use' END, s, s1, s2, -1 FROM rules WHERE kind = 'push'
    UNION ALL SELECT 'spawn', s, s2, s1, -1 FROM rules WHERE kind = 'spawn'"""
)
def transition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree transitions of every rule; term -1: that of the last child."""
    none = F.lit(None).cast("bigint")

    def row(node, one, two, term: int):
        node = F.lit(node) if isinstance(node, str) else node
        return F.struct(node.alias("node"), F.col("s"), one.alias("child1"), two.alias("child2"), F.lit(term).alias("term"))

    open_ = F.col("lock").isNull()
    found = (
        F.when(F.col("kind") == "pop", F.array(row("ret", none, none, 1)))
        .when(F.col("kind") == "base", F.array(row("base", F.col("s1"), none, -1)))
        .when(F.col("kind") == "spawn", F.array(row("spawn", F.col("s2"), F.col("s1"), -1)))
        .otherwise(F.array(row(F.when(open_, "call1").otherwise("acq"), F.col("s1"), none, 0), row(F.when(open_, "call2").otherwise("use"), F.col("s1"), F.col("s2"), -1)))
    )
    rules = source.derived(spark, sf_dir)
    leaves = rules.select("s").distinct().select(F.inline(F.array(row("nil", none, none, 0))))
    return rules.select(F.inline(found)).unionByName(leaves)


@query(f"WITH RECURSIVE {DERIVED_SQL}, {EDGES_SQL}, r(x) AS (SELECT 0::BIGINT UNION SELECT y FROM r JOIN edges USING (x)) SELECT x FROM r")
def forward_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.forward(source.edges(source.derived(spark, sf_dir)), _start(spark))


@query(f"WITH RECURSIVE {DERIVED_SQL}, {EDGES_SQL}, r(x) AS (SELECT DISTINCT s FROM rules WHERE s % 50 = 7 UNION SELECT e.x FROM r JOIN edges e ON e.y = r.x) SELECT x FROM r")
def backward_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = source.derived(spark, sf_dir)
    return graph.backward(source.edges(rules), rules.where("s % 50 = 7").select(F.col("s").alias("x")))


@query(
    f"""WITH RECURSIVE {DERIVED_SQL}, {EDGES_SQL}, r(x) AS (SELECT 0::BIGINT UNION SELECT y FROM r JOIN edges USING (x)),
    m AS (SELECT y AS x FROM edges WHERE x IN (SELECT x FROM r) GROUP BY y HAVING count(*) > 1 OR y = 0),
    f(x) AS (SELECT x FROM m UNION SELECT y FROM f JOIN edges USING (x)) SELECT x FROM f"""
)
def executed_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.executed_many(source.edges(source.derived(spark, sf_dir)), _start(spark))


@query(
    f"""WITH RECURSIVE {DERIVED_SQL}, {EDGES_SQL}, o AS (SELECT * FROM edges WHERE y NOT IN (SELECT s FROM rules WHERE kind = 'spawn')),
    w(x, fact) AS (SELECT s, lock FROM rules WHERE lock IS NOT NULL UNION SELECT o.x, w.fact FROM w JOIN o ON o.y = w.x) SELECT x, fact FROM w"""
)
def wait_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = source.derived(spark, sf_dir)
    seed = rules.where("lock is not null").select(F.col("s").alias("x"), F.col("lock").alias("fact"))
    return graph.spread_back(source.edges(rules), seed, rules.where("kind = 'spawn'").select(F.col("s").alias("x")))


@query(
    f"""WITH RECURSIVE {DERIVED_SQL},
    n AS (SELECT s, s1 AS t, CASE WHEN kind = 'push' AND lock IS NOT NULL THEN 1::BIGINT << lock::INTEGER ELSE 0 END AS more, 1 AS keep FROM rules WHERE s1 IS NOT NULL
          UNION ALL SELECT s, s2, 0, CASE WHEN kind = 'spawn' THEN 0 ELSE 1 END FROM rules WHERE s2 IS NOT NULL),
    d(s, held) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT n.t, (d.held * n.keep) | n.more FROM d JOIN n ON n.s = d.s) SELECT s, held FROM d"""
)
def demand_held_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = _start(spark, "s").withColumn("held", F.lit(0).cast("bigint"))
    return locks.demanded(source.derived(spark, sf_dir), seed)


@query(
    f"""WITH RECURSIVE {DERIVED_SQL}, t(s) USING KEY (s) AS (
        SELECT s FROM rules WHERE kind = 'pop'
        UNION (SELECT DISTINCT n.s FROM (
            SELECT r.s FROM rules r JOIN t ON t.s = r.s1 WHERE r.kind IN ('base', 'spawn')
            UNION SELECT r.s FROM rules r JOIN t ON t.s = r.s1 JOIN recurring.t a ON a.s = r.s2 WHERE r.kind = 'push'
            UNION SELECT r.s FROM rules r JOIN t ON t.s = r.s2 JOIN recurring.t a ON a.s = r.s1 WHERE r.kind = 'push') n
            WHERE NOT EXISTS (SELECT 1 FROM recurring.t k WHERE k.s = n.s)))
    SELECT s FROM t"""
)
def can_terminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.terminating(source.derived(spark, sf_dir))


_JOINED = "(least(2, (a.q >> 2) + (b.q >> 2)) * 4 + ((a.q & 3) | (b.q & 3)))::INTEGER"
_FACTS_SQL = f"""WITH RECURSIVE {DERIVED_SQL},
    leaf AS (SELECT s, 0 AS term, (CASE WHEN s % 7 = 0 OR s % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN s % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN s % 11 = 0 THEN 1 ELSE 0 END)::INTEGER AS q FROM q),
    f(s, term, q) USING KEY (s, term, q) AS (
        SELECT * FROM leaf UNION SELECT s, 1, 0 FROM rules WHERE kind = 'pop'
        UNION (SELECT DISTINCT n.s, n.term, n.q FROM (
            SELECT r.s, f.term, f.q FROM rules r JOIN f ON f.s = r.s1 WHERE r.kind = 'base'
            UNION SELECT r.s, 0, f.q FROM rules r JOIN f ON f.s = r.s1 WHERE r.kind = 'push' AND f.term = 0
            UNION SELECT r.s, b.term, {_JOINED} FROM rules r JOIN f a ON a.s = r.s1 AND a.term = 1 JOIN recurring.f b ON b.s = r.s2 WHERE r.kind = 'push'
            UNION SELECT r.s, b.term, {_JOINED} FROM rules r JOIN recurring.f a ON a.s = r.s1 AND a.term = 1 JOIN f b ON b.s = r.s2 WHERE r.kind = 'push'
            UNION SELECT r.s, b.term, {_JOINED} FROM rules r JOIN f a ON a.s = r.s2 JOIN recurring.f b ON b.s = r.s1 WHERE r.kind = 'spawn'
            UNION SELECT r.s, b.term, {_JOINED} FROM rules r JOIN recurring.f a ON a.s = r.s2 JOIN f b ON b.s = r.s1 WHERE r.kind = 'spawn') n
            WHERE NOT EXISTS (SELECT 1 FROM recurring.f k WHERE k.s = n.s AND k.term = n.term AND k.q = n.q)))"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("s"))
    return conflict.saturate(source.derived(spark, sf_dir), symbols, F.col("s") % 7 == 0, F.col("s") % 11 == 0)


@query(f"{_FACTS_SQL} SELECT s, term, q FROM f")
def conflict_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query(f"{_FACTS_SQL} SELECT bool_or(s = 0 AND q = 11) AS conflict, count(DISTINCT CASE WHEN q = 11 THEN s END) AS symbols FROM f")
def two_set_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two processes can stand at symbols of the two sets at once, from the initial symbol;
    and from how many symbols."""
    hit = F.col("q") == conflict.CONFLICT
    return _facts(spark, sf_dir).agg(F.max((F.col("s") == source.INITIAL) & hit).alias("conflict"), F.count_distinct(F.when(hit, F.col("s"))).alias("symbols"))


@query(
    """SELECT l_orderkey, bit_or(1::BIGINT << (l_suppkey % 8)::INTEGER) AS used, bit_and(1::BIGINT << (l_linenumber % 8)) AS same,
        bit_or((1::BIGINT << (l_suppkey % 8)::INTEGER) << (8 * (l_linenumber % 7))) AS graph, max(CASE WHEN (1::BIGINT << (l_suppkey % 8)::INTEGER) & (1::BIGINT << l_linenumber) = 0 THEN 1 ELSE 0 END) AS apart
    FROM lineitem GROUP BY l_orderkey"""
)
def lockset_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 8).alias("used"), F.col("l_linenumber").alias("line"))
    one, two = locks.bit(F.col("used")), locks.bit(F.col("line"))
    order = locks.after(F.lit(0).cast("bigint"), F.col("line") % 7, one)
    return rows.groupBy("l_orderkey").agg(F.bit_or(one).alias("used"), F.bit_and(locks.bit(F.col("line") % 8)).alias("same"), F.bit_or(order).alias("graph"), F.max(locks.disjoint(one, two).cast("int")).alias("apart"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_linenumber % 8 AS x, l_suppkey % 8 AS y FROM lineitem),
    p(o, x, y) AS (SELECT * FROM e UNION SELECT p.o, p.x, e.y FROM p JOIN e ON p.o = e.o AND p.y = e.x)
    SELECT o AS l_orderkey, NOT bool_or(x = y) AS acyclic FROM p GROUP BY o"""
)
def lock_graph_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    order = F.call_function("shiftleft", locks.bit(F.col("l_suppkey") % 8), (F.col("l_linenumber") % 8 * 8).cast("int"))
    return rows.groupBy("l_orderkey").agg(F.bit_or(order).alias("graph")).select("l_orderkey", locks.acyclic(F.col("graph")).alias("acyclic"))


#: Locks of ``lock_orders``: a supplier's order graph has at most the square of this many edges, however many its lines.
_LOCKS = 200


@query(
    f"""WITH RECURSIVE l AS (SELECT l_suppkey AS k, l_partkey % {_LOCKS} AS a, l_orderkey % {_LOCKS} AS b, l_suppkey % 3 = 0 AND l_linenumber = 6 AS back FROM lineitem),
    e AS (SELECT DISTINCT k, CASE WHEN back THEN greatest(a, b) ELSE least(a, b) END AS x, CASE WHEN back THEN least(a, b) ELSE greatest(a, b) END AS y FROM l WHERE a <> b),
    p(k, x, y) AS (SELECT * FROM e UNION SELECT p.k, p.x, e.y FROM p JOIN e ON p.k = e.k AND p.y = e.x)
    SELECT k AS l_suppkey, (SELECT count(*) FROM e WHERE e.k = p.k) AS orders, NOT bool_or(x = y) AS acyclic FROM p GROUP BY k"""
)
def lock_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order graphs over many locks, one of each supplier: their edges, and whether they have no circle (C4)."""
    line = _table(spark, sf_dir, "lineitem").select("l_suppkey", *((F.col(c) % _LOCKS).cast("bigint").alias(n) for c, n in (("l_partkey", "a"), ("l_orderkey", "b"))), "l_linenumber").where("a <> b")
    back = (F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") == 6)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edge = F.struct(F.when(back, high).otherwise(low).alias("x"), F.when(back, low).otherwise(high).alias("y"))
    graphs = line.select("l_suppkey", edge.alias("edge")).distinct().groupBy("l_suppkey").agg(F.collect_list("edge").alias("graph"))
    return graphs.select("l_suppkey", F.size("graph").cast("bigint").alias("orders"), locks.LISTS.acyclic(F.col("graph")).alias("acyclic"))


@query(
    """SELECT w.user_id, w.event_id AS write_id, r.event_id AS read_id FROM events w JOIN events r
    ON w.user_id = r.user_id AND w.event_type IN ('purchase', 'signup') AND r.event_type IN ('view', 'click') AND r.ts > w.ts"""
)
def dep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a write and a later read of one object."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    writes = rows.where(F.col("event_type").isin("purchase", "signup")).select("user_id", F.col("event_id").alias("write_id"), F.col("ts").alias("written"))
    reads = rows.where(F.col("event_type").isin("view", "click")).select("user_id", F.col("event_id").alias("read_id"), "ts")
    return writes.join(reads, "user_id").where("ts > written").select("user_id", "write_id", "read_id")


@query("SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS reads, count(*) FILTER (event_type IN ('purchase', 'signup')) AS writes, count(*) AS instrs FROM events GROUP BY user_id")
def field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind.isin("view", "click")).alias("reads"), F.count_if(kind.isin("purchase", "signup")).alias("writes"), F.count("*").alias("instrs"))


@query(networks.ordered_sql(False))
def ordered_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published answers for small networks, without locks; no table of ``sf_dir`` is read."""
    return networks.ordered(spark, False)


@query(networks.ordered_sql(True))
def ordered_reachability_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with locks heeded."""
    return networks.ordered(spark, True)


_STATUS_SQL ="SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'Positive' WHEN 'O' THEN 'Negative' ELSE 'Undecided' END AS status FROM orders"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("o_orderstatus")
    return _table(spark, sf_dir, "orders").select("o_custkey", F.when(code == "F", "Positive").when(code == "O", "Negative").otherwise("Undecided").alias("status"))


def _roll_sql(order: tuple[str, ...]) -> str:
    names = ", ".join(f"'{x}'" for x in order)
    return f"""WITH t AS ({_STATUS_SQL}) SELECT o_custkey, list_extract([{names}], min(list_position([{names}], status))::INTEGER) AS status, count(*) AS total,
        count(*) FILTER (status = 'Positive') AS positive, count(*) FILTER (status = 'Negative') AS negative FROM t GROUP BY o_custkey"""


@query(_roll_sql(status.CONJUNCTIVE))
def status_rollup_conj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.roll_up(_statuses(spark, sf_dir), "o_custkey", "status", status.CONJUNCTIVE)


@query(_roll_sql(status.DISJUNCTIVE))
def status_rollup_disj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.roll_up(_statuses(spark, sf_dir), "o_custkey", "status", status.DISJUNCTIVE)


@query(
    f"""WITH {DERIVED_SQL}, a AS (SELECT DISTINCT s FROM rules WHERE s % 7 = 0), b AS (SELECT DISTINCT s FROM rules WHERE s % 11 = 0)
    SELECT 'union' AS op, s FROM (SELECT s FROM a UNION SELECT s FROM b) UNION ALL SELECT 'both', s FROM (SELECT s FROM a INTERSECT SELECT s FROM b)
    UNION ALL SELECT 'rest', s FROM (SELECT DISTINCT s FROM rules EXCEPT SELECT s FROM a)"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = source.derived(spark, sf_dir).select("s").distinct()
    a, b = every.where("s % 7 = 0"), every.where("s % 11 = 0")
    named = lambda op, d: d.select(F.lit(op).alias("op"), "s")
    return named("union", a.union(b).distinct()).unionByName(named("both", a.intersect(b))).unionByName(named("rest", every.exceptAll(a)))


@query(f"WITH {DERIVED_SQL} SELECT p_partkey AS s FROM part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT s FROM rules)")
def subset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a conflict set that have no rule."""
    wanted = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s")).where("s % 3 = 0")
    return wanted.join(source.derived(spark, sf_dir).select("s").distinct(), "s", "left_anti")


_REACHING = f"""WITH RECURSIVE {DERIVED_SQL}, {EDGES_SQL},
    g AS (SELECT s AS x, z % 5 AS var, s % 10 AS def FROM q WHERE k = 4),
    r(x, var, def) AS (SELECT * FROM g UNION SELECT e.y, r.var, r.def FROM r JOIN edges e ON e.x = r.x
        WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.x = e.y AND g.var = r.var)) SELECT x, var, def FROM r"""


def _definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _table(spark, sf_dir, "part").where("p_size % 10 = 4")
    gen = part.select(F.col("p_partkey").cast("bigint").alias("x"), (F.col("p_size") % 5).cast("bigint").alias("var"), (F.col("p_partkey") % 10).cast("bigint").alias("def"))
    return source.edges(source.derived(spark, sf_dir)), gen


@query(_REACHING)
def genkill_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions (var, def) that hold after a node: its own, or those of its predecessors that it
    does not overwrite."""
    return graph.reaching(*_definitions(spark, sf_dir))


@query(_REACHING)
def stratified_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by levels of components."""
    edges, gen = _definitions(spark, sf_dir)
    kill = gen.select("x", "var").distinct()
    return strata.stratified(edges, gen, lambda rows, ways: graph.past_kills(rows, ways, kill))


from weft.plans import flows, heights, lattices, outcomes, programs, samples, shared, structures  # noqa: E402, F401  (registers its queries)

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
