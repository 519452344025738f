"""Trimmed base rules, and saturation of automata over sets of configurations.

An automaton over configurations of many processes reads, process by process, a control state
and then a stack.  Tables: ``sp`` (a, p, b): from a place between processes a by control p into
b; ``tt`` (a, sym, b): by a stack symbol; ``ts`` (a, b): the process ends, on to place b;
``final`` (a).  Saturation adds the transitions of all configurations that lead into the set.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Row

from weft.operators.fixpoint import least_fixpoint, spread_bits
from weft.sources.scratch import Tables

#: States of an automaton, at most, whose transitions by one symbol are a set of bits in one number.
FEW = 7


def trim_base(base: DataFrame, interesting: DataFrame) -> DataFrame:
    """action, s, s1: base rules of one action in a row as one rule, between interesting symbols;
    ``base``: action, s, s1; ``interesting``: s.  Where the action changes is interesting as well."""
    after = base.select(F.col("s").alias("s1"), F.col("action").alias("next"))
    change = base.join(after, "s1").where("action <> next").select(F.col("s1").alias("s"))
    wanted = interesting.select("s").unionByName(change).distinct()
    seed = base.join(wanted, "s", "left_semi").select("action", "s", "s1")
    more = base.select("action", F.col("s").alias("s1"), F.col("s1").alias("s2"))
    step = lambda new, _: new.join(more, ["action", "s1"]).select("action", "s", F.col("s2").alias("s1"))
    return least_fixpoint(seed, step).join(wanted.withColumnRenamed("s", "s1"), "s1", "left_semi").select("action", "s", "s1")


def saturate(rules: DataFrame, sp: DataFrame, ts: DataFrame, tt: DataFrame) -> DataFrame:
    """a, sym, b: all stack transitions of the configurations from which the set can be reached;
    ``rules``: kind, g, s, g1, s1, g2, s2.  In an automaton of up to ``FEW`` states the transitions by a symbol
    are one row while they are sought."""
    ends = [sp.select(F.explode(F.array("a", "b")).alias("a")), ts.select(F.explode(F.array("a", "b")).alias("a")), tt.select(F.explode(F.array("a", "b")).alias("a"))]
    states = sorted(r.a for r in ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct().limit(FEW + 1).collect())
    places = sp.select("a", "p", "b").distinct().limit(FEW * FEW + 1).collect()
    if len(states) <= FEW and len(places) == len({(r.a, r.p) for r in places}) <= FEW * FEW and len({r.p for r in places}) <= FEW:
        return _saturate_bits(rules, places, ts, tt, states)
    return _saturate_rows(rules, sp, ts, tt)


def _saturate_bits(rules: DataFrame, places: list[Row], ts: DataFrame, tt: DataFrame, states: list[int]) -> DataFrame:
    """``saturate`` with the transitions of a symbol as bits: that from the i-th of n states to the k-th is bit i * n + k.  No
    pairs of transitions are made; ``places`` (sp) and ``ts`` lie between ``states``, so there are few of them."""
    n, place = len(states), {a: i for i, a in enumerate(states)}
    into = {(place[r.a], r.p): place[r.b] for r in places}
    behind = [(place[r.a], place[r.b]) for r in ts.distinct().collect()]
    controls = sorted({p for _, p in into})
    of = lambda bits, i: f"(shiftright({bits}, {i * n}) & {(1 << n) - 1}L)"
    set_in = lambda bits, i, k: f"shiftright({bits}, {i * n + k}) & 1L = 1L"

    def all_of(parts: list[str]) -> str:
        return " | ".join(parts) or "0L"

    def spawned(place_: int, g2: int, g1: int) -> str:
        ends = [f"CASE WHEN {set_in('got', into[place_, g2], end)} THEN {of('b2', into[to, g1])} ELSE 0L END" for end, to in behind if (to, g1) in into]
        return all_of(ends)

    def found(g: int, g1: int, g2: int) -> dict[str, str]:
        """What a rule adds to its symbol, by its kind: at each place where its controls can stand."""
        at = [(into[i, g], into[i, g1]) for i in range(n) if (i, g) in into and (i, g1) in into]
        push = [f"shiftleft({all_of([f'CASE WHEN {set_in("got", a1, mid)} THEN {of("b2", mid)} ELSE 0L END' for mid in range(n)])}, {a * n})" for a, a1 in at]
        spawn = [f"shiftleft({spawned(i, g2, g1)}, {into[i, g] * n})" for i in range(n) if (i, g) in into and (i, g2) in into]
        return {"base": all_of([f"shiftleft({of('got', a1)}, {a * n})" for a, a1 in at]), "push": all_of(push), "spawn": all_of(spawn)}

    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))
    index = F.create_map(*(x for a, i in place.items() for x in (F.lit(a).cast("bigint"), F.lit(i))))
    seed = tt.select("sym", bit(F.element_at(index, F.col("a").cast("bigint")) * n + F.element_at(index, F.col("b").cast("bigint"))).alias("bits"))
    pops = F.coalesce(*(F.when((F.col("g") == g) & (F.col("g1") == h), F.lit(sum({1 << into[i, g] * n + into[i, h] for i in range(n) if (i, g) in into and (i, h) in into}))) for g in controls for h in controls), F.lit(0))
    popped = rules.where("kind = 'pop'").select(F.col("s").alias("sym"), pops.cast("bigint").alias("bits"))
    # in: what must lead on from the place, the callee or the process that is spawned; out: what comes after it
    swapped = F.col("kind") == "spawn"
    ways = rules.where("kind <> 'pop'").select("kind", "g", "g1", "g2", "s", F.when(swapped, F.col("s2")).otherwise(F.col("s1")).alias("in"), F.when(swapped, F.col("s1")).otherwise(F.col("s2")).alias("out"))
    tables = Tables(rules.sparkSession)
    ways = tables.read(ways.schema, tables.write(ways))
    known = {(g, h, k): found(g, h, k) for g in controls for h in controls for k in controls}
    # only a spawn has a second control
    cases = [(kind, f"g = {g} AND g1 = {h}" + (f" AND g2 = {k}" if kind == "spawn" else ""), x[kind]) for (g, h, k), x in known.items() for kind in x if kind == "spawn" or k == controls[0]]
    more = F.expr(f"CASE {' '.join(f"WHEN kind = '{kind}' AND {when} THEN {what}" for kind, when, what in cases)} ELSE 0L END") if cases else F.lit(0).cast("bigint")

    def step(rows: DataFrame) -> DataFrame:
        at = lambda symbol, bits, fresh: rows.select(F.col("sym").alias(symbol), F.col("bits").alias(bits), F.col("fresh").alias(fresh))
        both = ways.join(at("in", "got", "f1"), "in").join(at("out", "b2", "f2"), "out", "left").where("f1 <> 0 or f2 <> 0")
        both = both.withColumn("b2", F.coalesce("b2", F.lit(0).cast("bigint")))
        return both.select(F.col("s").alias("sym"), more.alias("bits"))

    bits = spread_bits(seed.unionByName(popped), step, ["sym"])
    pairs = F.array(*(F.struct(F.lit(i * n + k).alias("i"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for i, a in enumerate(states) for k, b in enumerate(states)))
    each = bits.select("sym", F.explode(F.filter(pairs, lambda x: F.call_function("shiftright", "bits", x["i"]).bitwiseAND(F.lit(1).cast("bigint")) == 1)).alias("x"))
    return each.select("x.a", "sym", "x.b")


def _saturate_rows(rules: DataFrame, sp: DataFrame, ts: DataFrame, tt: DataFrame) -> DataFrame:
    """``saturate`` with a row for each transition, for automata of any size."""

    def of(kind: str) -> DataFrame:
        return rules.where(F.col("kind") == kind).select("g", "s", "g1", "s1", "g2", "s2")

    place = lambda p, b: sp.select(F.col("a").alias("place"), F.col("p").alias(p), F.col("b").alias(b))
    # for each rule: the place, where it begins (a) and where its successor begins (a1)
    placed = lambda kind, p: of(kind).join(place("g", "a"), "g").join(place(p, "a1"), ["place", p])
    base, push = placed("base", "g1").select("s", "a", "a1", "s1"), placed("push", "g1").select("s", "a", "a1", "s1", "s2")
    popped = placed("pop", "g1").select("a", F.col("s").alias("sym"), F.col("a1").alias("b"))
    spawn = placed("spawn", "g2").select("s", "a", F.col("a1").alias("a2"), "s2", "g1", "s1")
    ends = ts.select(F.col("a").alias("end"), F.col("b").alias("place"))
    behind = ends.join(place("g1", "a1"), "place").select("end", "g1", "a1")

    def on(rows: DataFrame, a: str, sym: str, b: str) -> DataFrame:
        return rows.select(F.col("a").alias(a), F.col("sym").alias(sym), F.col("b").alias(b))

    found = lambda rows: rows.select("a", F.col("s").alias("sym"), "b")

    def step(new: DataFrame, known: DataFrame) -> DataFrame:
        out = found(base.join(on(new, "a1", "s1", "b"), ["a1", "s1"]))
        for one, two in ((new, known), (known, new)):
            out = out.unionByName(found(push.join(on(one, "a1", "s1", "mid"), ["a1", "s1"]).join(on(two, "mid", "s2", "b"), ["mid", "s2"])))
            started = spawn.join(on(one, "a2", "s2", "end"), ["a2", "s2"]).join(behind, ["end", "g1"])
            out = out.unionByName(found(started.join(on(two, "a1", "s1", "b"), ["a1", "s1"])))
        return out

    return least_fixpoint(tt.select("a", "sym", "b").unionByName(popped.select("a", "sym", "b")), step)


def accepted(tt: DataFrame, sp: DataFrame, final: DataFrame, start: int, g: int, s: int) -> DataFrame:
    """One row, accepted: whether the configuration (g, s) of one process is in the set."""
    first = sp.where((F.col("a") == start) & (F.col("p") == g)).select(F.col("b").alias("a"))
    hits = tt.where(F.col("sym") == s).join(first, "a", "left_semi").select(F.col("b").alias("a")).join(final, "a", "left_semi")
    return hits.agg((F.count("*") > 0).alias("accepted"))


def one_set_twice(controls: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """The set of configurations in which two processes stand at symbols of one set (R9), by formula:
    ``controls``: p (numbered from 0); ``symbols``: sym, hit (in the set).  Places 0 to 2 count the
    processes found; stacks end in 0 to 3, and 4 and on are the states after a control."""
    count = controls.agg(F.count("*").alias("n"))
    sp = controls.select("p", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(3)))).alias("a")).join(F.broadcast(count))  # one row
    sp = sp.select("a", "p", (F.col("a") * F.col("n") + F.col("p") + 4).alias("b"))
    rest, hit = symbols.where("not hit").select("sym"), symbols.where("hit").select("sym")

    def into(place: int, which: DataFrame, b: int) -> DataFrame:
        states = sp.where(F.col("a") == place).select(F.col("b").alias("a"))
        return which.join(F.broadcast(states)).select("a", "sym", F.lit(b).cast("bigint").alias("b"))  # as many states as controls

    loops = symbols.select(F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(4)))).alias("a"), "sym").withColumn("b", F.col("a"))
    tt = loops.unionByName(into(0, rest, 0)).unionByName(into(0, hit, 1)).unionByName(into(1, rest, 2)).unionByName(into(1, hit, 3)).unionByName(into(2, symbols.select("sym"), 3))
    back = sp.select(F.col("b").alias("a"), F.col("a").alias("b"))
    fixed = controls.sparkSession.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2)], "a bigint, b bigint")
    final = sp.where("a = 2").select(F.col("b").alias("a")).unionByName(controls.sparkSession.range(3, 4).select(F.col("id").alias("a")))
    return {"sp": sp.select("a", "p", "b"), "ts": back.unionByName(fixed), "tt": tt, "final": final}


def two_sets(controls: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """The set of configurations with one process at a symbol of the first set and another at one of
    the second (R8), in either order: places 0 none yet, 1 the first found, 2 the second found, 3
    both; ``symbols``: sym, one, two.  A process that is not counted leaves the place as it is, also
    where its symbol is of a set already found; the states after a control are 10 * place + 10 + p."""
    spark = controls.sparkSession
    wide = controls.agg((F.max("p") + 10).alias("w"))
    sp = controls.select("p", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(4)))).alias("a")).join(F.broadcast(wide))  # one row
    sp = sp.select("a", "p", (F.col("a") * F.col("w") + F.col("p") + 10).alias("b"))
    always = F.lit(True)
    one, two = F.col("one"), F.col("two")
    # a stack that begins with a symbol ends in the number of the place that follows
    moves = [(0, one, 1), (0, two, 2), (0, ~one & ~two, 0), (1, two, 3), (1, ~two, 1), (2, one, 3), (2, ~one, 2), (3, always, 3)]
    parts = []
    for place, wanted, then in moves:
        states = sp.where(F.col("a") == place).select(F.col("b").alias("a"))
        parts.append(symbols.where(wanted).join(F.broadcast(states)).select("a", "sym", F.lit(then).cast("bigint").alias("b")))  # as many states as controls
    tt = symbols.select(F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(4)))).alias("a"), "sym").withColumn("b", F.col("a"))
    for part in parts:
        tt = tt.unionByName(part)
    ts = sp.select(F.col("b").alias("a"), F.col("a").alias("b")).unionByName(spark.range(4).select(F.col("id").alias("a"), F.col("id").alias("b")))
    final = sp.where("a = 3").select(F.col("b").alias("a")).unionByName(spark.range(3, 4).select(F.col("id").alias("a")))
    return {"sp": sp.select("a", "p", "b"), "ts": ts, "tt": tt, "final": final}


def facts(tables: dict[str, DataFrame]) -> DataFrame:
    """line: an automaton as facts, one line each, for other engines (K5)."""
    parts = [d.select(F.format_string(f"{name}({', '.join(['%s'] * len(d.columns))}).", *(F.col(c).cast("string") for c in d.columns)).alias("line")) for name, d in sorted(tables.items())]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def dot(tables: dict[str, DataFrame]) -> DataFrame:
    """line: the edges of an automaton in the notation of a graph drawer (K7); end states are doubled."""
    edge = lambda a, b, label: F.format_string('  "%s" -> "%s" [label="%s"];', F.col(a).cast("string"), F.col(b).cast("string"), label)
    tt = tables["tt"].select(edge("a", "b", F.col("sym").cast("string")).alias("line"))
    sp = tables["sp"].select(F.format_string('  "s%s" -> "%s" [label="%s"];', F.col("a").cast("string"), F.col("b").cast("string"), F.col("p").cast("string")).alias("line"))
    ts = tables["ts"].select(F.format_string('  "%s" -> "s%s" [style=dashed];', F.col("a").cast("string"), F.col("b").cast("string")).alias("line"))
    final = tables["final"].select(F.format_string('  "%s" [shape=doublecircle];', F.col("a").cast("string")).alias("line"))
    return tt.unionByName(sp).unionByName(ts).unionByName(final)
