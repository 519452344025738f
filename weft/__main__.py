"""``python -m weft [-e] [-w] [-s] [-p settings] [-h] file``: answers the question in a file (Q16, Q17)."""

from __future__ import annotations

import argparse
import sys

import pyspark.sql.functions as F
from pyspark.sql import SparkSession

from weft.operators import explore, witness
from weft.sources import settings, text


def arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="weft", description="Whether two sets of symbols of a network can be reached at once.")
    parser.add_argument("file", help="a network and a question (with -e a network is enough)")
    parser.add_argument("-e", "--explore", action="store_true", help="run the network step by step instead")
    parser.add_argument("-w", "--witness", action="store_true", help="print a witness")
    parser.add_argument("-s", "--states", action="store_true", help="print a witness with the states of its nodes")
    parser.add_argument("-p", "--settings", help="a file of settings, one name = value a line")
    return parser.parse_args(given)


def conflict(spark: SparkSession, task: text.Task, with_witness: bool, states: bool) -> int:
    if not with_witness:
        found = text.conflicts(spark, {"q": task})["q"]
        print(str(found).lower())
    else:
        rules, initial = text.tables(spark, {"q": task.network})
        with_locks = task.with_locks and bool(task.network.locks())
        nodes = witness.of_conflict(rules, initial, text.sets(spark, {"q": [task.first, task.second]}), with_locks)
        lines = witness.printed(nodes, states).first()
        found = lines is not None
        print(f"witness\n{lines.text}" if found else "no witness")
    print("A conflict could exist." if found else "No conflict can exist.", file=sys.stderr)
    return 0


def walk(spark: SparkSession, network: text.Network, ask=input) -> int:
    """Prints the rules that can be taken, takes the one whose number is entered; ends with an empty line."""
    rules, _ = text.tables(spark, {"q": network})
    config = explore.begin(spark, *network.initial)
    while True:
        # one configuration of one network, as entered by hand
        for p in sorted(config.collect(), key=lambda p: p.pid):
            print(f"{p.pid}: {p.g} {' '.join(f.s + (f'@{f.lock}' if f.lock is not None else '') for f in p.stack)}")
        ready = explore.enabled(rules, explore.tops(config), explore.locks_held(config))
        found = sorted(ready.collect(), key=lambda r: (r.pid, r.kind, r.action, r.g1, r.s1 or "", r.s2 or ""))
        for i, r in enumerate(found):
            print(f"  [{i}] {r.pid}: {r.kind} {r.action}")
        entered = ask() if found else ""
        if not entered.strip():
            return 0
        taken = found[int(entered)]
        rows = explore.step(config, spark.createDataFrame([taken], ready.schema)).collect()
        config = spark.createDataFrame(rows, explore.CONFIGURATION)


def main(given: list[str] | None = None) -> int:
    options = arguments(sys.argv[1:] if given is None else given)
    try:
        own = settings.find(options.settings)
    except (OSError, ValueError) as e:
        print(f"settings: {e}", file=sys.stderr)
        return 1
    try:
        with open(options.file, encoding="utf-8") as f:
            found = text.parse_any(f.read())
        if not options.explore and not isinstance(found, text.Task):
            raise ValueError("the file holds no question")
    except (OSError, ValueError) as e:
        print(f"{options.file}: {e}", file=sys.stderr)
        return 1
    builder = SparkSession.builder.appName("weft").config("spark.ui.showConsoleProgress", "false")
    spark = settings.apply(builder, own).getOrCreate()
    if options.explore:
        return walk(spark, found.network if isinstance(found, text.Task) else found)
    return conflict(spark, found, options.witness or options.states, options.states)


if __name__ == "__main__":
    sys.exit(main())
