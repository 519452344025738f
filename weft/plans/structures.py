"""Queries on components, trimming, saturation and isolation over the derived network."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from weft.operators import components, isolation, saturation
from weft.plans.registry import query
from weft.sources import rules as source
from weft.sources.rules import DERIVED_SQL, EDGES_SQL

_CLOSED = f"""WITH RECURSIVE {DERIVED_SQL}, {EDGES_SQL}, n AS (SELECT x FROM edges UNION SELECT y FROM edges),
    c(x, y) AS (SELECT x, y FROM edges UNION SELECT c.x, e.y FROM c JOIN edges e ON e.x = c.y),
    scc AS (SELECT n.x, least(n.x, coalesce(min(a.y), n.x)) AS component FROM n LEFT JOIN (SELECT a.x, a.y FROM c a JOIN c b ON b.x = a.y AND b.y = a.x) a ON a.x = n.x GROUP BY n.x)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = source.edges(source.derived(spark, sf_dir))
    return edges.select(F.explode(F.array("x", "y")).alias("x")).distinct(), edges


@query(f"{_CLOSED} SELECT x, component FROM scc")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(*_graph(spark, sf_dir))


@query(f"{_CLOSED} SELECT count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM scc GROUP BY component)")
def scc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(*_graph(spark, sf_dir)).groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("largest"))


@query(f"{_CLOSED} SELECT x FROM c WHERE x = y")
def in_cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.in_cycle(*_graph(spark, sf_dir))


@query(
    f"""{_CLOSED}, d AS (SELECT DISTINCT a.component AS f, b.component AS t FROM edges JOIN scc a ON a.x = edges.x JOIN scc b ON b.x = edges.y WHERE a.component <> b.component),
    l(component, level) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT d.t, l.level + 1 FROM l JOIN d ON d.f = l.component)
    SELECT component, (SELECT count(*) FROM scc s WHERE s.component = l.component) AS size, max(level) AS level FROM l GROUP BY component"""
)
def scc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.levels(*_graph(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {DERIVED_SQL}, b AS (SELECT s % 3 AS action, s, s1 FROM rules WHERE kind = 'base'),
    w AS (SELECT s FROM rules WHERE kind <> 'base' UNION SELECT s1 FROM rules WHERE kind <> 'base' AND s1 IS NOT NULL UNION SELECT s2 FROM rules WHERE s2 IS NOT NULL
        UNION SELECT x.s1 FROM b x JOIN b y ON y.s = x.s1 WHERE x.action <> y.action),
    t(action, s, s1) AS (SELECT * FROM b UNION SELECT t.action, t.s, b.s1 FROM t JOIN b ON b.s = t.s1 AND b.action = t.action)
    SELECT action, s, s1 FROM t WHERE s IN (SELECT s FROM w) AND s1 IN (SELECT s FROM w)"""
)
def trim_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions are symbols modulo 3."""
    rules = source.derived(spark, sf_dir)
    base = rules.where("kind = 'base'").select((F.col("s") % 3).alias("action"), "s", "s1")
    other = rules.where("kind <> 'base'").select(F.explode(F.array("s", "s1", "s2")).alias("s")).where("s is not null")
    return saturation.trim_base(base, other.distinct())


def _automaton(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    zero = F.lit(0).cast("bigint")
    rules = source.derived(spark, sf_dir).select("kind", zero.alias("g"), "s", zero.alias("g1"), "s1", zero.alias("g2"), "s2")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("sym"))
    return rules, saturation.one_set_twice(spark.range(1).select(F.col("id").alias("p")), part.withColumn("hit", F.col("sym") % 7 == 0))


_SEEDS = """sp AS (SELECT range AS a, 0::BIGINT AS p, range + 4 AS b FROM range(3)),
    ts AS (SELECT b AS a, a AS b FROM sp UNION ALL SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 1), (2, 1), (3, 2))),
    hits AS (SELECT s AS sym, s % 7 = 0 AS hit FROM q),
    seed AS (SELECT range AS a, sym, range AS b FROM range(4), hits UNION SELECT 4, sym, CASE WHEN hit THEN 1 ELSE 0 END FROM hits
        UNION SELECT 5, sym, CASE WHEN hit THEN 3 ELSE 2 END FROM hits UNION SELECT 6, sym, 3 FROM hits)"""
_SATURATED = f"""WITH RECURSIVE {DERIVED_SQL}, {_SEEDS}, tt(a, sym, b) USING KEY (a, sym, b) AS (
    SELECT a, sym, b FROM seed UNION SELECT sp.b, s, sp.b FROM rules, sp WHERE kind = 'pop'
    UNION (SELECT DISTINCT n.a, n.sym, n.b FROM (
        SELECT t.a, r.s AS sym, t.b FROM rules r JOIN tt t ON t.sym = r.s1 WHERE r.kind = 'base' AND t.a >= 4
        UNION SELECT t.a, r.s, u.b FROM rules r JOIN tt t ON t.sym = r.s1 JOIN recurring.tt u ON u.sym = r.s2 AND u.a = t.b WHERE r.kind = 'push' AND t.a >= 4
        UNION SELECT t.a, r.s, u.b FROM rules r JOIN recurring.tt t ON t.sym = r.s1 JOIN tt u ON u.sym = r.s2 AND u.a = t.b WHERE r.kind = 'push' AND t.a >= 4
        UNION SELECT t.a, r.s, u.b FROM rules r JOIN tt t ON t.sym = r.s2 JOIN ts e ON e.a = t.b JOIN sp f ON f.a = e.b JOIN recurring.tt u ON u.sym = r.s1 AND u.a = f.b WHERE r.kind = 'spawn' AND t.a >= 4
        UNION SELECT t.a, r.s, u.b FROM rules r JOIN recurring.tt t ON t.sym = r.s2 JOIN ts e ON e.a = t.b JOIN sp f ON f.a = e.b JOIN tt u ON u.sym = r.s1 AND u.a = f.b WHERE r.kind = 'spawn' AND t.a >= 4) n
        WHERE NOT EXISTS (SELECT 1 FROM recurring.tt k WHERE k.a = n.a AND k.sym = n.sym AND k.b = n.b)))"""


@query(f"{_SATURATED} SELECT a, sym, b FROM tt")
def mnfs_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations from which two processes can come to symbols of one set at once."""
    rules, found = _automaton(spark, sf_dir)
    return saturation.saturate(rules, found["sp"], found["ts"], found["tt"])


_PAIR_SEEDS = """sp AS (SELECT range AS a, 0::BIGINT AS p, range * 10 + 10 AS b FROM range(4)),
    hits AS (SELECT s AS sym, s % 7 = 0 AS one, s % 11 = 0 AS two FROM q)"""


@query(
    f"""WITH {DERIVED_SQL}, {_PAIR_SEEDS}
    SELECT 'sp' AS part, a, p AS sym, b FROM sp UNION ALL SELECT 'ts', b, -1, a FROM sp UNION ALL SELECT 'ts', range, -1, range FROM range(4)
    UNION ALL SELECT 'final', 40, -1, -1 UNION ALL SELECT 'final', 3, -1, -1
    UNION ALL SELECT 'tt', range, sym, range FROM range(4), hits
    UNION ALL SELECT 'tt', 10, sym, 1 FROM hits WHERE one UNION ALL SELECT 'tt', 10, sym, 2 FROM hits WHERE two UNION ALL SELECT 'tt', 10, sym, 0 FROM hits WHERE NOT one AND NOT two
    UNION ALL SELECT 'tt', 20, sym, CASE WHEN two THEN 3 ELSE 1 END FROM hits UNION ALL SELECT 'tt', 30, sym, CASE WHEN one THEN 3 ELSE 2 END FROM hits UNION ALL SELECT 'tt', 40, sym, 3 FROM hits"""
)
def mnfs_conflict_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("sym"))
    found = saturation.two_sets(spark.range(1).select(F.col("id").alias("p")), part.select("sym", (F.col("sym") % 7 == 0).alias("one"), (F.col("sym") % 11 == 0).alias("two")))
    none = F.lit(-1).cast("bigint")
    rows = found["sp"].select(F.lit("sp").alias("part"), "a", F.col("p").alias("sym"), "b")
    rows = rows.unionByName(found["ts"].select(F.lit("ts").alias("part"), "a", none.alias("sym"), "b"))
    rows = rows.unionByName(found["final"].select(F.lit("final").alias("part"), "a", none.alias("sym"), none.alias("b")))
    return rows.unionByName(found["tt"].select(F.lit("tt").alias("part"), "a", "sym", "b"))


@query(
    f"""WITH {DERIVED_SQL}, {_SEEDS} SELECT concat('sp(', a, ', ', p, ', ', b, ').') AS line FROM sp UNION ALL SELECT concat('ts(', a, ', ', b, ').') FROM ts
    UNION ALL SELECT concat('tt(', a, ', ', sym, ', ', b, ').') FROM seed UNION ALL SELECT 'final(6).' UNION ALL SELECT 'final(3).'"""
)
def mnfs_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saturation.facts(_automaton(spark, sf_dir)[1])


@query(
    f"""WITH {DERIVED_SQL}, {_SEEDS} SELECT concat('  "s', a, '" -> "', b, '" [label="', p, '"];') AS line FROM sp UNION ALL SELECT concat('  "', a, '" -> "s', b, '" [style=dashed];') FROM ts
    UNION ALL SELECT concat('  "', a, '" -> "', b, '" [label="', sym, '"];') FROM seed UNION ALL SELECT '  "6" [shape=doublecircle];' UNION ALL SELECT '  "3" [shape=doublecircle];'"""
)
def mnfs_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saturation.dot(_automaton(spark, sf_dir)[1])


@query(
    f"""WITH {DERIVED_SQL}, c AS (SELECT kind, s, s1, s2, lock, s % 2 = 0 AS can, s % 5 = 0 AS own, CASE kind WHEN 'push' THEN s1 WHEN 'spawn' THEN s2 END AS callee FROM rules),
    caller AS (SELECT c.*, iso FROM c, (VALUES ('I'), ('S'), ('N')) v(iso) WHERE can = (iso <> 'N')),
    pairs AS (SELECT r.*, i AS inner_iso FROM caller r, (VALUES ('I'), ('S'), ('N')) v(i) WHERE callee IS NOT NULL AND
        CASE WHEN callee % 2 <> 0 THEN i = 'N' AND NOT (can AND own AND iso = 'I') WHEN can AND own THEN i = iso ELSE i <> 'N' END)
    SELECT DISTINCT kind, s, s1, s2, CASE WHEN kind = 'push' AND inner_iso = 'I' AND callee % 3 = 0 THEN 7 ELSE lock END AS lock, iso,
        CASE WHEN kind = 'push' THEN inner_iso ELSE iso END AS iso1, CASE WHEN kind = 'spawn' THEN inner_iso ELSE iso END AS iso2 FROM pairs
    UNION ALL SELECT DISTINCT kind, s, s1, s2, lock, iso, CASE WHEN s1 IS NOT NULL THEN iso END, NULL FROM caller WHERE callee IS NULL"""
)
def isolation_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even symbols can belong to the object, every fifth calls on itself, every third callee locks it."""
    rules = source.derived(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("s"))
    return isolation.product(rules, part.where("s % 2 = 0"), part.where("s % 5 = 0"), part.where("s % 3 = 0"), 7)
