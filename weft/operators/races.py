"""Data races (Q8, Q12, Q13): two accesses to one field of one object, one of them a write, by two
processes at once.

Every (field, object) that is written is a question of its own; all are answered by one fixpoint.  Without locks they
are told apart by bits (``questions``).  With locks they are told apart by ``qid``, and each is asked of its own slice of the network: the symbols from
which its accesses can be reached, found for all questions at once as sets of bits.  What leaves the slice is only
asked whether it returns.  Verdicts come as soon as they fall; statuses roll up by field and over all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from weft.operators import automata, build, emptiness, graph, locks, status
from weft.operators import questions as conflicts
from weft.operators.numbering import numbered
from weft.sources.program import Program
from weft.sources.scratch import Tables

RULE = ("kind", "g", "s", "g1", "s1", "g2", "s2", "lock", "bad")


def questions(p: Program) -> tuple[DataFrame, DataFrame]:
    """qid, field, obj of what is written at all; and the sets (qid, i, s): 0 all accesses, 1 the writes."""
    rows = build.accesses(p).withColumn("qid", F.concat_ws(":", "field", "obj"))
    written = rows.where("kind = 'put'").select("qid", "field", "obj").distinct()
    rows = rows.join(written.select("qid"), "qid", "left_semi").select("qid", "kind", build.symbol().alias("s"))
    return written, rows.select("qid", F.lit(0).alias("i"), "s").unionByName(rows.where("kind = 'put'").select("qid", F.lit(1).alias("i"), "s")).distinct()


def _edges(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("s").alias("x"), F.explode(F.array("s1", "s2")).alias("y")).where("y is not null").distinct()


def question_rules(rules: DataFrame, initial: DataFrame, sets: DataFrame, with_locks: bool) -> DataFrame:
    """qid and a network: for each question the rules of its slice, and for a symbol that a rule leads to outside of
    the slice rules that pop it, to wherever it can end: below it no access is found.  With locks, a slice also has
    what reaches a push with a lock that it uses; other locks do not constrain it.

    ``initial``: qid, g, s; ``sets``: qid, i, s; numbers of locks and types as in ``emptiness``."""
    tables = Tables(rules.sparkSession)
    keep = lambda rows: tables.read(rows.schema, tables.write(rows))
    names = keep(numbered(initial.select("qid").distinct(), "qid", "question"))
    zero = F.lit(0).cast("bigint")
    once = initial.select(zero.alias("qid"), "g", "s").distinct()
    whole = keep(emptiness.demand_and_ends(rules.select(zero.alias("qid"), *RULE), once, False))
    rules = keep(rules.select(*RULE).join(whole.where("rel = 'D'").select("g", "s").distinct(), ["g", "s"], "left_semi").select(*RULE))
    edges = _edges(rules)
    seeds = sets.join(names, "qid").select(F.col("s").alias("x"), "question").distinct()
    slices = keep(graph.question_slices(edges, seeds))
    if with_locks:
        taken = rules.where("kind = 'push' and lock is not null").select("lock", F.col("s").alias("x")).distinct()
        using = slices.join(taken, "x").groupBy("lock", "word").agg(F.bit_or("bits").alias("bits")).join(taken, "lock")
        more = graph.questions_of(using.select("x", "word", "bits")).distinct()
        slices = keep(graph.question_slices(edges, seeds.unionByName(more).distinct()))
    inside = rules.join(slices.withColumnRenamed("x", "s"), "s").select(*RULE, "word", "bits")
    led = inside.select(F.explode(F.array("s1", "s2")).alias("x"), "word", "bits").where("x is not null")
    own = slices.withColumnRenamed("bits", "own")
    outside = led.groupBy("x", "word").agg(F.bit_or("bits").alias("bits")).join(own, ["x", "word"], "left")
    outside = outside.select(F.col("x").alias("s"), "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("own", zero))).alias("bits")).where("bits <> 0")
    ends = whole.where("rel = 'R'").select("g", "s", F.col("gf").alias("g1"))
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema}
    popped = outside.join(ends, "s").select(F.lit("pop").alias("kind"), "g", "s", "g1", blank["s1"], blank["g2"], blank["s2"], blank["lock"], zero.alias("bad"), "word", "bits")
    found = graph.questions_of(inside.unionByName(popped)).join(names, "question").select("qid", *RULE)
    return keep(found)


def verdicts(rules: DataFrame, initial: DataFrame, sets: DataFrame, with_locks: bool, algebra=locks.BITS, progress=None) -> Iterator[DataFrame]:
    """Tables (qid, status) of questions as soon as they are decided: Positive for a possible race, else Negative."""
    if not with_locks:
        yield from _without_locks(rules, initial, sets, progress)
        return
    own = question_rules(rules, initial, sets, with_locks)
    automaton = automata.conflict(with_locks, algebra)
    value = F.when(F.col("reached"), "Positive").otherwise("Negative")
    for found in emptiness.verdicts(own, initial, sets, automaton, 0, with_locks, algebra, progress):
        yield found.select("qid", value.alias("status"))


def _without_locks(rules: DataFrame, initial: DataFrame, sets: DataFrame, progress) -> Iterator[DataFrame]:
    """``verdicts`` without locks: the questions are bits over one network, no question has rules of its own."""
    tables = Tables(rules.sparkSession)
    names = numbered(initial.select("qid").distinct(), "qid", "question")
    place, bit = (F.col("question") / graph.WORD).cast("bigint"), (F.col("question") % graph.WORD).cast("int")
    names = names.select("qid", place.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit"))
    path = tables.write(names)
    names, left = tables.read(names.schema, path), tables.read(names.schema, path)
    words = names.groupBy("word").agg(F.bit_or("bit").alias("mask"))
    begins = initial.join(names, "qid").groupBy("s", "g", "word").agg(F.bit_or("bit").alias("bits"))
    hits = sets.join(names, "qid").select("i", "s", "word", F.col("bit").alias("bits"))
    for found in conflicts.reached(rules.select(*RULE), begins, hits, words, progress):
        now = left.join(found, "word").where("bit & bits <> 0").select("qid")
        left = left.join(now, "qid", "left_anti")
        yield now.withColumn("status", F.lit("Positive"))
    yield left.select("qid", F.lit("Negative").alias("status"))


def program_questions(p: Program, main: Column, unique: DataFrame, exceptions: bool = True) -> tuple[DataFrame, ...]:
    """The questions of a program (qid, field, obj), its network, and initial symbols and sets of each question."""
    asked, sets = questions(p)
    rules = build.without_actions(build.network(p, p.nodes.select("node"), build.safe_locks(p, unique), build.monitor_exits(p)))
    rules = rules if exceptions else rules.where("g <> 1 and g1 <> 1")
    taken = numbered(rules.where("lock is not null").select("lock").distinct(), "lock", "number")
    rules = rules.join(taken, "lock", "left").drop("lock").withColumnRenamed("number", "lock").withColumn("bad", F.lit(0).cast("bigint"))
    initial = asked.select("qid", F.lit(0).alias("g"), F.concat(main.cast("int").cast("string"), F.lit(".0.0")).alias("s"))
    return asked, rules, initial, sets


def report(p: Program, main: Column, unique: DataFrame, with_locks: bool = True, algebra=locks.BITS, progress=None, exceptions: bool = True) -> DataFrame:
    """field, obj, status: Positive for a possible race, else Negative.  ``main`` gives the node where the
    program of a question (field, obj) begins; without ``exceptions`` only runs that throw none."""
    return reduce(DataFrame.unionByName, updates(p, main, unique, with_locks, algebra, progress, exceptions))


def updates(p: Program, main: Column, unique: DataFrame, with_locks: bool = True, algebra=locks.BITS, progress=None, exceptions: bool = True) -> Iterator[DataFrame]:
    """The rows of ``report`` in tables, each as soon as its questions are decided."""
    asked, rules, initial, sets = program_questions(p, main, unique, exceptions)
    for found in verdicts(rules, initial, sets, with_locks, algebra, progress):
        yield asked.join(found, "qid").select("field", "obj", "status")


def rolled_up(results: DataFrame) -> DataFrame:
    """level (object, field, all), field, obj, status, total, positive, negative: the results, their roll-up by
    field and that over all; null where a level has no field or object."""
    none = lambda c: F.lit(None).cast(results.schema[c].dataType).alias(c)
    one = lambda s: F.count_if(F.col("status") == s)
    single = results.select(F.lit("object").alias("level"), "field", "obj", "status", F.lit(1).cast("bigint").alias("total"), (F.col("status") == "Positive").cast("bigint").alias("positive"), (F.col("status") == "Negative").cast("bigint").alias("negative"))
    fields = by_field(results).select(F.lit("field").alias("level"), "field", none("obj"), "status", "total", "positive", "negative")
    any_status = F.when(F.col("race"), "Positive").otherwise("Negative").alias("status")
    counts = results.agg(F.count("*").alias("total"), one("Positive").alias("positive"), one("Negative").alias("negative"))
    top = any_race(results).join(counts).select(F.lit("all").alias("level"), none("field"), none("obj"), any_status, "total", "positive", "negative")
    return single.unionByName(fields).unionByName(top)


def by_field(results: DataFrame) -> DataFrame:
    """field, status, total, positive, negative."""
    return status.roll_up(results, "field", "status", status.DISJUNCTIVE)


def any_race(results: DataFrame) -> DataFrame:
    """One row, race: whether any is possible."""
    return results.agg(F.coalesce(F.max(F.col("status") == "Positive"), F.lit(False)).alias("race"))
