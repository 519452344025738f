"""Result trees, progress and time limits, the command line, steps of a network."""

import time

import pytest

from weft import __main__ as command
from weft.operators import explore, progress, results
from weft.operators.fixpoint import least_fixpoint
from weft.sources import text

TREE = [
    ("t", [], "any", None, None), ("t", ["a"], "all", None, "x"), ("t", ["a", "1"], "base", "Positive", None), ("t", ["a", "2"], "base", "Undecided", None),
    ("t", ["b"], "all", None, None), ("u", [], "all", None, None), ("v", [], "base", "Negative", None),
]


def tree(spark):
    return spark.createDataFrame(TREE, results.SCHEMA)


def test_statuses_and_print(spark):
    found = results.statuses(tree(spark))
    assert {(r.tree, "/".join(r.path)): (r.status, r.total, r.positive, r.negative) for r in found.collect()} == {
        ("t", ""): ("Positive", 2, 1, 0), ("t", "a"): ("Undecided", 2, 1, 0), ("t", "a/1"): ("Positive", 1, 1, 0), ("t", "a/2"): ("Undecided", 1, 0, 0),
        ("t", "b"): ("Positive", 0, 0, 0), ("u", ""): ("Positive", 0, 0, 0), ("v", ""): ("Negative", 1, 0, 1),
    }
    assert {r.tree: r.text for r in results.printed(found).collect()} == {
        "t": ": Positive\n  a: Undecided\n    1: Positive\n    2: Undecided\n  b: Positive", "u": ": Positive", "v": ": Negative",
    }
    assert results.statuses(spark.createDataFrame([], results.SCHEMA)).count() == 0


def test_updates(spark):
    change = lambda *path: spark.createDataFrame([("t", list(path), "Negative")], "tree string, path array<string>, value string")
    found = results.statuses(results.update(tree(spark), change("a", "2")))
    assert {r.status for r in found.where("tree = 't' and size(path) > 0 and path[0] = 'a' and size(path) = 1").collect()} == {"Negative"}
    for wrong in (("a", "1"), ("a",), ("z",)):
        with pytest.raises(Exception, match="result|decided"):
            results.update(tree(spark), change(*wrong)).collect()
    details = results.update_detail(tree(spark), spark.createDataFrame([("t", ["b"], "new")], "tree string, path array<string>, detail string"))
    assert {("/".join(r.path)): r.detail for r in details.where("tree = 't' and size(path) = 1").collect()} == {"a": "x", "b": "new"}
    assert {("/".join(r.path), r.kind) for r in results.look_up(tree(spark), "a").collect()} == {("", "all"), ("1", "base"), ("2", "base")}


def test_progress(spark, capsys):
    whole = progress.Progress.printing("whole", 10)
    part = whole.part("part", 4, 5)
    part.worked(2)
    part.finish()
    assert (part.done, whole.done) == (4, 5)
    assert "whole: 5 of 10" in capsys.readouterr().out
    whole.cancel()
    with pytest.raises(progress.Cancelled):
        part.worked(1)
    forever = lambda new, _: new.selectExpr("x + 1 as x")
    with pytest.raises(progress.Cancelled):
        least_fixpoint(spark.range(1).selectExpr("id as x"), forever, report=part)
    began = time.time()
    with pytest.raises(TimeoutError), progress.limited(spark, 2) as limit:
        least_fixpoint(spark.range(1).selectExpr("id as x"), forever, report=limit)
    assert time.time() - began < 60
    with pytest.raises(RuntimeError, match="no fixpoint"):
        least_fixpoint(spark.range(1).selectExpr("id as x"), forever, rounds=2)


NETWORK = "dpn{ initial(a) rules{ (a)--x-->(b:>c) (b)--y-l-->(d,e) (c)--y-l-->(d,e) (d)--z-->() } }"


def test_steps(spark):
    rules, _ = text.tables(spark, {"q": text.parse(NETWORK)})
    config = explore.begin(spark, "0", "a")
    stacks = lambda c: {r.pid: [(f.s, f.lock) for f in r.stack] for r in c.collect()}
    ready = lambda c: explore.enabled(rules, explore.tops(c), explore.locks_held(c))
    config = explore.step(config, ready(config))
    assert stacks(config) == {"0": [("b", None)], "0.0": [("c", None)]}
    config = explore.step(config, ready(config).where("pid = '0'"))
    assert stacks(config) == {"0": [("d", 0), ("e", None)], "0.0": [("c", None)]}
    assert {(r.pid, r.kind) for r in ready(config).collect()} == {("0", "pop")}  # the other one has to wait
    config = explore.step(config, ready(config))
    assert {(r.pid, r.kind) for r in ready(config).collect()} == {("0.0", "push")}


def test_command(spark, tmp_path, capsys):
    file = tmp_path / "task"
    file.write_text(NETWORK + " check for conflict between {e} and {c}")
    task = text.parse_any(file.read_text())
    assert command.conflict(spark, task, False, False) == 0
    assert capsys.readouterr() == ("true\n", "A conflict could exist.\n")
    command.conflict(spark, task, True, False)
    assert capsys.readouterr().out.startswith("witness\nSpawn(x)\n")
    task.second = ["d"]
    task.first = ["d"]
    command.conflict(spark, task, True, False)
    assert capsys.readouterr() == ("no witness\n", "No conflict can exist.\n")
    entered = iter(["0", "0", ""])
    assert command.walk(spark, text.parse_any(NETWORK), lambda: next(entered)) == 0
    assert "0: 0 d@0 e\n0.0: 0 c\n  [0] 0: pop z\n" in capsys.readouterr().out
    assert command.main([str(tmp_path / "none")]) == 1
    assert command.arguments(["-e", "-s", "f"]).explore
