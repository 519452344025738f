"""Orders of states, settled questions, slices of many questions and numbers, against plain Python."""

import random

import pyspark.sql.functions as F

from weft.operators import graph
from weft.operators.fixpoint import Order, advance, least_fixpoint, spread_bits
from weft.operators.numbering import numbered
from weft.sources.scratch import Tables


def reach(edges, start):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_order_keeps_what_nothing_beats(spark):
    """Ways through a graph that collect locks: per node only the least sets are of use."""
    rnd = random.Random(3)
    edges = [(rnd.randrange(12), rnd.randrange(12), rnd.choice([0, 1, 2, 4])) for _ in range(30)]
    table = spark.createDataFrame(edges, "x long, y long, lock long")
    seed = spark.createDataFrame([(0, 0)], "x long, held long")
    step = lambda new, _: new.join(table, "x").select(F.col("y").alias("x"), F.col("held").bitwiseOR(F.col("lock")).alias("held"))
    order = Order(["x"], lambda one, other: one("held").bitwiseOR(other("held")) == other("held"))
    every = {tuple(r) for r in least_fixpoint(seed, step).collect()}
    found = {tuple(r) for r in order.best(least_fixpoint(seed, step, order=order)).collect()}
    assert found == {(x, h) for x, h in every if not any(x == y and k != h and k | h == h for y, k in every)}


def test_settled_questions_add_no_rows(spark):
    edges = spark.createDataFrame([(q, i, i + 1) for q in "ab" for i in range(6)], "qid string, x long, y long")
    seed = spark.createDataFrame([("a", 0), ("b", 0)], "qid string, x long")
    step = lambda new, _: new.join(edges, ["qid", "x"]).select("qid", F.col("y").alias("x"))
    hits = lambda new: new.where("(qid = 'a' and x = 2) or (qid = 'b' and x = 6)").select("qid")
    turns = [(t.number, t.count, [r.qid for r in t.settled.collect()] if t.settled else []) for t in advance(seed, step, settle=("qid", hits))]
    assert [q for _, _, q in turns if q] == [["a"], ["b"]]
    assert [n for _, n, _ in turns] == [2, 2, 2, 1, 1, 1, 1, 0]


def test_question_slices(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)]
    seeds = {(rnd.randrange(60), q) for q in range(130) for _ in range(2)}
    found = graph.question_slices(spark.createDataFrame(edges, "x long, y long"), spark.createDataFrame(list(seeds), "x long, question long"))
    got = {(r.x, r.question) for r in graph.questions_of(found).collect()}
    back = [(b, a) for a, b in edges]
    assert got == {(x, q) for q in range(130) for x in reach(back, [s for s, p in seeds if p == q])}


def test_numbers(spark):
    names = spark.createDataFrame([(f"n{i * 7 % 50:02}",) for i in range(50)], "name string").repartition(4)
    assert {(r["name"], r.place) for r in numbered(names, "name", "place").collect()} == {(f"n{i:02}", i) for i in range(50)}
    assert numbered(names.limit(0), "name", "place").count() == 0


def test_rounds_send_no_table_through_the_driver(spark):
    """Neither a round's rows nor what they are joined with are broadcast, however small."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(3)], "x long, y long")
    plans = []

    def step(new, known):
        found = new.join(edges, "x").select(F.col("y").alias("x"))
        plans.append(found.join(known, "x", "left_anti")._jdf.queryExecution().executedPlan().toString())
        return found

    assert least_fixpoint(spark.createDataFrame([(0,)], "x long"), step).count() == 4
    assert plans and not any("Broadcast" in p for p in plans)


def test_dealt_tables_stay(spark):
    """Tables dealt alike are joined where they lie, and a closure over them is that of a plain search."""
    tables = Tables(spark)
    (a, n), (b, _) = (tables.dealt(spark.range(50).selectExpr("id % 20 as x", f"id as {c}").repartition(3, "x"), "x", 3) for c in "ab")
    both = a.hint("merge").join(b, "x")
    assert n == 50 and both.count() == 10 * 9 + 10 * 4
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    edges = spark.range(40).selectExpr("id as x", "if(id % 7 = 3, null, (id * 3 + 1) % 40) as y")
    after, found = {r.x: r.y for r in edges.collect()}, {5}
    while not {after[x] for x in found} <= found | {None}:
        found |= {after[x] for x in found} - {None}
    assert {r.x for r in graph.forward(edges, spark.createDataFrame([(5,)], "x long")).collect()} == found


def test_executed_reads_edges_once(spark):
    """What runs, and what runs more than once: two sites, a call in a cycle, a way back to the start."""
    edges = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 1), (2, 4, 1), (3, 5, 1), (9, 3, 7)], "x long, y long, n long")
    start, looped = spark.createDataFrame([(0,)], "x long"), spark.createDataFrame([(3, 5), (9, 1)], "x long, y long")
    got = lambda *more: {(r.x, r.many) for r in graph.executed(edges, start, *more).collect()}
    assert got() == {(0, False), (1, False), (2, True), (3, False), (4, True), (5, False)}
    assert got(looped) == {(0, False), (1, False), (2, True), (3, False), (4, True), (5, True)}


def test_rounds_make_no_columns(spark, monkeypatch):
    """Columns of a fixpoint over bits are made once: twice the rounds make no more of them."""
    one, made = F.lit(1).cast("bigint"), []
    kind, plain = type(one), type(one).bitwiseOR
    monkeypatch.setattr(kind, "bitwiseOR", lambda self, other: (made.append(1), plain(self, other))[1])

    def chain(n):
        edges = spark.range(n).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
        to = [F.col("y").alias("x"), one.alias("bits")]
        made.clear()
        found = spread_bits(spark.range(1).select(F.col("id").alias("x"), one.alias("bits")), lambda rows: rows.where("fresh <> 0").join(edges, "x").select(*to), ["x"])
        return found.count(), len(made)

    (few, once), (more, again) = chain(3), chain(7)
    assert (few, more) == (4, 8) and once == again == 1
