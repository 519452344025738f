"""Small networks and ordered reachability questions with published answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.operators import emptiness
from weft.sources import text
from weft.sources.text import Network

#: The networks, in the text form.
NETWORKS = {
    1: """dpn{ initial(1,1) rules{
        (1,1)--t0-->(1,2) (1,2)--t1-->(1,3,10) (1,3)--t2-->(1,4:>1,10) (1,4)--t3-->(1) }}""",
    2: """dpn{ initial(1,1) rules{
        (1,1)--t0-->(1,2) (1,2)--t1-->(1,3) (1,3)--t2-->(1,4) (1,4)--t3-->(1,4) }}""",
    3: """dpn{ initial(1,a1) rules{
        (1,a1)--t0-->(1,a2) (1,a2)--t1-->(1,b1,a3) (1,a3)--t2-->(1,a4) (1,a4)--t3-->(1,a4)
        (1,b1)--t4-->(1,b2) (1,b2)--t5-->(1) (1,c1)--t6-->(1,d1,c2) (1,c2)--t7-->(1,c3) (1,c3)--t8-->(1,c3)
        (1,d1)--t9-->(1,d1,d2) (1,d2)--t10-->(1,d3) (1,d3)--t11-->(1) }}""",
    4: """dpn{ initial(1,a1) rules{
        (1,a1)--t0-->(1,a2) (1,a2)--t1-->(1,b1,a3) (1,a3)--t2-->(1,a4) (1,a4)--t3-->(1,a4)
        (1,b1)--t4-->(1,b2) (1,b2)--t5-->(1,b3:>1,c1) (1,b3)--t6-->(1) (1,c1)--t7-->(1,d1,c2)
        (1,c2)--t8-->(1,c3) (1,c3)--t9-->(1,c3) (1,d1)--t10-->(1,d1,d2) (1,d2)--t11-->(1,d3)
        (1,d3)--t12-->(1) }}""",
    5: """dpn{ initial(1,a1) rules{
        (1,a1)--t0-->(1,a2) (1,a2)--t1-->(1,b1,a3) (1,a3)--t2-->(1,a4) (1,a4)--t3-->(1,a4)
        (1,b1)--t4-->(1,b2) (1,b2)--t5-->(1,b3:>1,c1) (1,b3)--t6-->(1) (1,c1)--t7-->(1,d1,c2)
        (1,c2)--t8-->(1,c3) (1,c3)--t9-->(1,c3) (1,d1)--t10-->(1,d2) (1,d2)--t11-->(1,d3) (1,d3)--t12-->(1) }}""",
    6: """dpn{ initial(1,a1) rules{
        (1,a1)--t0-->(1,b1,a2) (1,a2)--t1-->(1,a3) (1,a3)--t2-->(1,a4) (1,a4)--t3-->(1,a4)
        (1,b1)--t4-->(1,b2:>1,c1) (1,b2)--t5-->(1) (1,c1)--t6-->(1,c2) (1,c2)--t7-->(1,c2) }}""",
    7: """dpn{ initial(a1) rules{
        (a1)--t0-l-->(b1,a2) (a2)--t1-->(a3) (a3)--t2-->(a4) (a4)--t3-->(a4) (b1)--t4-->(b2:>c1)
        (b2)--t5-->() (c1)--t6-l-->(d1,c2) (c2)--t7-->(c2) (d1)--t8-->(d2) (d2)--t9-->() }}""",
    8: """dpn{ initial(a0) rules{
        (a0)--t0-->(a1) (a1)--t1-l-->(b1,a2) (a2)--t2-->(a3) (a3)--t3-->(a3) (b1)--t4-->(b2) (b2)--t5-->() }}""",
    9: """dpn{ initial(a0) rules{
        (a0)--t0-->(a1:>c1) (a1)--t1-l-->(b1,a2) (a2)--t2-->(a3) (a3)--t3-->(a3) (b1)--t4-->(b2)
        (b2)--t5-->() (c1)--t6-l-->(d1,c2) (c2)--t7-->(c2) (d1)--t8-->(d2) (d2)--t9-->() }}""",
}

#: Fixed values: (network, symbols to be reached one after the other, locks heeded) to answer.
ORDERED = {
    (1, "1 2", False): True,
    (1, "2 1", False): False,
    (2, "1 2 3", False): True,
    (2, "3 2 1", False): False,
    (2, "1 2 3 4", False): True,
    (2, "3 2 1 4", False): False,
    (3, "a1 a2 a3 a4", False): True,
    (4, "a1 a4", False): True,
    (4, "a2 a4", False): True,
    (4, "a2 a3", False): True,
    (4, "a1 a2 a4", False): True,
    (4, "a2 a3 a4", False): True,
    (4, "a1 a2 a3 a4", False): True,
    (5, "a1 a4 a4", False): True,
    (5, "a1 a3 a4", False): True,
    (5, "a3 a4", False): True,
    (6, "a2 a3", False): True,
    (7, "d1 b2", False): True,
    (9, "b1 d1", False): True,
    (7, "a1 a2", True): True,
    (7, "a1 b1", True): True,
    (7, "d1", True): True,
    (7, "b1", True): True,
    (7, "d1 b2", True): False,
    (8, "a0 a1", True): True,
    (8, "a1 a2", True): True,
    (9, "b1 d1", True): True,
}


def network(i: int) -> Network:
    return text.parse(NETWORKS[i])


def ordered(spark: SparkSession, with_locks: bool, forbidden: bool = False) -> DataFrame:
    """(question, reached): the questions of one lock mode, all of one length in one run;
    ``forbidden`` adds the condition on forbidden actions, with none forbidden."""
    asked = [(i, stages) for (i, stages, mode) in ORDERED if mode == with_locks]
    whole = None
    for n in sorted({len(stages.split()) for _, stages in asked}):
        some = {f"{i}: {stages}": (network(i), [[s] for s in stages.split()]) for i, stages in asked if len(stages.split()) == n}
        rules, initial = text.tables(spark, {q: net for q, (net, _) in some.items()})
        found = emptiness.iterated(rules, initial, text.sets(spark, {q: m for q, (_, m) in some.items()}), n, with_locks, forbidden)
        found = found.withColumnRenamed("qid", "question")
        whole = found if whole is None else whole.unionByName(found)
    return whole


def ordered_sql(with_locks: bool) -> str:
    rows = ", ".join(f"('{i}: {stages}', {str(a).lower()})" for (i, stages, mode), a in ORDERED.items() if mode == with_locks)
    return f"SELECT question, reached FROM (VALUES {rows}) t(question, reached)"
