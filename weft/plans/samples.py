"""Small programs and networks with published or hand-derived answers."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from weft.operators import emptiness, locks, races, witness
from weft.plans import networks
from weft.plans.registry import query
from weft.sources import program, text

MAIN, CALLER, START, RUN, CALLEE = range(5)
#: What two methods do, in three programs; ``lock`` is a monitor on a shared object,
#: ``synchronized`` says that both methods lock their own object.  A race is possible or not.
PROGRAMS = {
    1: {"caller": ["new", "start", "enter", "get", "exit"], "callee": ["enter", "put", "exit"], "synchronized": False, "race": False},
    2: {"caller": ["new", "enter", "start", "exit", "get"], "callee": ["enter", "put", "exit"], "synchronized": False, "race": True},
    3: {"caller": ["start", "get"], "callee": ["put"], "synchronized": True, "race": False},
}
KINDS = {"new": "new", "start": "invoke", "enter": "menter", "exit": "mexit", "get": "get", "put": "put", "call": "invoke"}
LOCK, OWN, CLASS = 10, 20, 100


def samples(spark: SparkSession, numbers=tuple(PROGRAMS)) -> program.Program:
    """Main calls a method that starts a thread, whose run method calls the other one.  The nodes of
    program k are numbered from 10 * k, its objects end in k."""
    rows: dict[str, list] = {name: [] for name in program.SCHEMAS}
    for k in numbers:
        p = PROGRAMS[k]
        at, sync = 10 * k, p["synchronized"]
        bodies = {MAIN: ["call"], CALLER: p["caller"], RUN: ["call"], CALLEE: p["callee"]}
        targets = {MAIN: CALLER, CALLER: START, RUN: CALLEE}
        rows["nodes"] += [(at + n, k, "Application", n in (CALLER, CALLEE) and not sync, n in (CALLER, CALLEE) and sync, n == START, True) for n in range(5)]
        rows["blocks"] += [(at + n, b, False, b == 1) for n in bodies for b in (0, 1)]
        rows["succ"] += [(at + n, 0, 1, False, 0) for n in bodies]
        rows["instr"] += [(at + n, 0, i, KINDS[x], 9 if x in ("get", "put") else 2, 0, False) for n, own in bodies.items() for i, x in enumerate(own)]
        rows["call_targets"] += [(at + n, 0, i, at + targets[n]) for n, own in bodies.items() for i, x in enumerate(own) if KINDS[x] == "invoke"] + [(at + START, 0, 0, at + RUN)]
        rows["points_to"] += [(at + n, v, o + k) for n in bodies for v, o in ((1, OWN), (2, LOCK), (9, CLASS))]
        rows["class_obj"].append((k, CLASS + k))
    return program.from_rows(spark, rows)


@query("SELECT * FROM (VALUES (1, 'Negative'), (2, 'Positive'), (3, 'Negative')) t(program, status)")
def race_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published answers for three programs, runs without exceptions; no table of ``sf_dir`` is read."""
    p = samples(spark)
    found = races.report(p, (F.col("obj") - CLASS) * 10, p.points_to.select("obj").distinct(), exceptions=False)
    return found.select((F.col("obj") - CLASS).cast("int").alias("program"), "status")


#: Networks in the text form: a read and a write around one lock, as in the programs above but with
#: the thread started before, inside or after the lock; and two writes one after the other.
FLOWS = {
    "inside": """dpn{ initial(m0) rules{ (m0)--enter-l-->(b0,m9) (b0)--start-->(b1:>t0) (b1)--read-->(b2) (b2)--exit-->()
        (t0)--enter-l-->(w0,t9) (w0)--write-->(w1) (w1)--exit-->() }}""",
    "after": """dpn{ initial(m0) rules{ (m0)--enter-l-->(b0,b1) (b0)--start-->(b2:>t0) (b2)--exit-->() (b1)--read-->(b3)
        (t0)--enter-l-->(w0,t9) (w0)--write-->(w1) (w1)--exit-->() }}""",
    "whole": """dpn{ initial(m0) rules{ (m0)--enter-l-->(p0,m9) (p0)--start-->(b1:>t0) (b1)--read-->(b2) (b2)--return-->()
        (t0)--enter-l-->(w0,t9) (w0)--write-->(w1) (w1)--return-->() }}""",
    "replaced": "dpn{ initial(w0) rules{ (w0)--first-->(w1) (w1)--write-->(v1) (v1)--other-->(b1) (b1)--read-->(b2) }}",
    "kept": "dpn{ initial(w0) rules{ (w0)--first-->(w1) (w1)--other-->(v1) (v1)--other-->(b1) (b1)--read-->(b2) }}",
    "branch": "dpn{ initial(w0) rules{ (w0)--first-->(w1) (w1)--write-->(b1) (w1)--other-->(b1) (b1)--read-->(b2) }}",
}
#: Whether a read can follow the write; with overwrites heeded; at once.
SUCCESSIVE = {"inside": False, "after": True, "whole": False, "replaced": True, "kept": True, "branch": True}
UNREPLACED = {"inside": False, "after": True, "whole": False, "replaced": False, "kept": True, "branch": True}
PARALLEL = {("inside", "w1", "b1"): False, ("inside", "t0", "b1"): True, ("after", "w1", "b1"): True, ("whole", "w1", "b1"): False}


def _asked(spark: SparkSession, names, sets) -> tuple[DataFrame, DataFrame, DataFrame]:
    nets = {q: text.parse(FLOWS[n]) for q, n in names.items()}
    # no write of the networks with a lock replaces another one
    bad = {q: [{"write"}] if names[q] in ("replaced", "kept", "branch") else [] for q in names}
    rules, initial = text.tables(spark, nets, bad)
    return rules, initial, text.sets(spark, sets)


def _sql(rows: dict, name: str) -> str:
    values = ", ".join(f"('{q if isinstance(q, str) else ' '.join(q)}', {str(a).lower()})" for q, a in rows.items())
    return f"SELECT * FROM (VALUES {values}) t(question, {name})"


@query(_sql(SUCCESSIVE, "reached"))
def may_happen_successively(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write, then a read, with locks; no table of ``sf_dir`` is read."""
    asked = _asked(spark, {n: n for n in FLOWS}, {n: [["w1"], ["b1"]] for n in FLOWS})
    return emptiness.flows(*asked, True).withColumnRenamed("qid", "question")


@query(_sql(UNREPLACED, "reached"))
def may_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where no certain write may come between; no table of ``sf_dir`` is read."""
    asked = _asked(spark, {n: n for n in FLOWS}, {n: [["w1"], ["b1"]] for n in FLOWS})
    return emptiness.flows(*asked, True, True).withColumnRenamed("qid", "question")


@query(_sql(PARALLEL, "reached"))
def may_happen_in_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points at once, with locks; no table of ``sf_dir`` is read."""
    names = {" ".join(k): k[0] for k in PARALLEL}
    asked = _asked(spark, names, {" ".join(k): [[k[1]], [k[2]]] for k in PARALLEL})
    return emptiness.two_sets(*asked, True).withColumnRenamed("qid", "question")


#: Two processes at one set under a lock each of ``n``: the same lock excludes them.
_LOCKS = {f"{n} {kind}": kind == "other" for n in (1, 8, 9, 12) for kind in ("same", "other")}


@query(_sql(_LOCKS, "reached"))
def many_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two processes behind a chain of locks, with sets of any number of locks."""
    nets, sets = {}, {}
    for q, other in _LOCKS.items():
        n = int(q.split()[0])
        chain = lambda p, first: " ".join(f"({p}{i})--x-{first if i == 0 else f'l{i}'}-->({p}{i + 1},{p}e{i})" for i in range(n))
        # the processes share their first lock, or (other) share none
        second = chain("b", "m") if other else chain("b", "l0")
        second = second.replace("-l", "-k") if other else second
        nets[q] = text.parse(f"dpn{{ initial(s) rules{{ (s)--go-->(a0:>b0) {chain('a', 'l0')} {second} }}}}")
        sets[q] = [[f"a{n}", f"b{n}"]]
    rules, initial = text.tables(spark, nets)
    return emptiness.one_set(rules, initial, text.sets(spark, sets), True, locks.LISTS).withColumnRenamed("qid", "question")


#: In this network d1 calls itself for ever, so d2 is never reached.
_CONTEXT = {"d1 c1": True, "d2 c1": False, "d1 a2": False, "b2 a2": True, "d1 d1": True}


@query(_sql(_CONTEXT, "reached"))
def call_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol that a process stands at, called from another one, in a small network."""
    net = networks.network(4)
    rules, initial = text.tables(spark, dict.fromkeys(_CONTEXT, net))
    return emptiness.in_context(rules, initial, text.sets(spark, {q: [[s] for s in q.split()] for q in _CONTEXT}), 2).withColumnRenamed("qid", "question")


@query("SELECT question, reached AS witness FROM (" + networks.ordered_sql(True) + ") WHERE question NOT LIKE '%: %1' OR question LIKE '%: % %'")
def witness_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of questions of two stages with locks: whether a witness was made."""
    asked = [(i, stages) for (i, stages, mode) in networks.ORDERED if mode and len(stages.split()) == 2]
    some = {f"{i}: {stages}": (networks.network(i), [[s] for s in stages.split()]) for i, stages in asked}
    rules, initial = text.tables(spark, {q: net for q, (net, _) in some.items()})
    found = witness.of_order(rules, initial, text.sets(spark, {q: m for q, (_, m) in some.items()}), 2, True)
    have = found.select("qid").distinct().withColumn("witness", F.lit(True))
    return initial.join(have, "qid", "left").select(F.col("qid").alias("question"), F.coalesce("witness", F.lit(False)).alias("witness"))
