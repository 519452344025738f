"""Text form, conflicts with and without locks, ordered reachability with published answers."""

import pytest

from weft.operators import emptiness
from weft.plans import networks
from weft.sources import text

TASK = """
dpn{ // one lock around both sets
  controls{0:"run"} locks{l:"lock"}
  initial(0,m0)
  rules{
    (0,m0)--fork-->(0,m1:>0,w0), /* both start */
    (0,m1)--enter-l-->(0,m2,m3)
    (0,m2)--leave-->(0)
    (0,w0)--enter-l-->(0,w1,w2)
    (0,w1)--leave-->(0)
  } }
check for conflict %s between {m2} and {w1}
"""


def test_tasks(spark):
    tasks = {"locks": text.parse_task(TASK % ""), "nolocks": text.parse_task(TASK % "nolocks")}
    assert text.conflicts(spark, tasks) == {"locks": False, "nolocks": True}


def test_round_trip():
    network = text.parse_task(TASK % "").network
    again = text.parse(text.print_network(network))
    assert again.rules == network.rules
    assert again.names["controls"] == {"0": "run"} and again.names["locks"] == {"l": "lock"}
    numbered = text.parse(text.print_network(network, numbered=True))
    assert [r.kind for r in numbered.rules] == [r.kind for r in network.rules]
    assert numbered.initial == ("0", "0")
    assert numbered.names["locks"] == {"0": "lock"} and numbered.names["stacks"]["0"] == "m0"


def test_without_controls():
    rules = text.parse("dpn{ initial(a) rules{ (a)--x-->(b:>c) (b)--y-->(c,d) (d)--z-->() }}")
    assert [(r.kind, r.g, r.s1, r.s2) for r in rules.rules] == [("spawn", "0", "b", "c"), ("push", "0", "c", "d"), ("pop", "0", None, None)]


@pytest.mark.parametrize("bad", ["dpn{", "dpn{ rules{} }", "dpn{ initial(a) } x", "dpn{ initial(a) rules{ (a)->(b) } }", "dpn{ initial(a) ? }"])
def test_errors(bad):
    with pytest.raises(ValueError):
        text.parse(bad)


@pytest.mark.parametrize("sets", ["{} and {w1}", "{m2} and {nowhere}"])
def test_sets_are_checked(sets):
    with pytest.raises(ValueError):
        text.parse_task((TASK % "").replace("{m2} and {w1}", sets))


def test_nine_locks_are_an_error(spark):
    rules, initial = text.tables(spark, {"q": text.parse("dpn{ initial(a) rules{" + " ".join(f"(a)--x-l{i}-->(b,c)" for i in range(9)) + "}}")})
    with pytest.raises(ValueError):
        emptiness.two_sets(rules, initial, text.sets(spark, {"q": [["a"], ["b"]]}), True)


@pytest.mark.parametrize("with_locks", [False, True])
def test_ordered(spark, with_locks):
    got = {r.question: r.reached for r in networks.ordered(spark, with_locks).collect()}
    assert got == {f"{i}: {stages}": answer for (i, stages, mode), answer in networks.ORDERED.items() if mode == with_locks}


def test_forbidden_actions(spark):
    """1 to 2 to 3 to 4: 3 can be reached after 2 unless the rule between them is forbidden."""
    net = networks.network(2)
    stages = [["2"], ["3"]]
    forbidden = {"free": [set()], "other": [{"t0", "t2"}], "barred": [{"t1"}]}
    rules, initial = text.tables(spark, dict.fromkeys(forbidden, net), forbidden)
    found = emptiness.iterated(rules, initial, text.sets(spark, dict.fromkeys(forbidden, stages)), 2, False, True)
    assert {r.qid: r.reached for r in found.collect()} == {"free": True, "other": True, "barred": False}
