"""Least fixpoints of recursive rules, evaluated semi-naively."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from weft.sources.scratch import Tables

#: Rounds after which the rounds' tables are merged into one.
MERGE = 12
#: Rules or edges that one bucket of a fixpoint's tables holds.
BUCKET = 100_000


def _apart(rows: DataFrame) -> DataFrame:
    """A round's table, joined by sorting: a broadcast would pass it, or what it is joined with, through the driver, and
    there are as many as rounds."""
    return rows.hint("merge")


@dataclass(eq=False)
class Order:
    """Which rows make others needless: rows that agree in ``on`` are compared by ``better``, which tells
    from two look-ups of columns whether the first row is at least as good as the second.  It is a partial
    order, and a step from a better row gives a better row."""

    on: Sequence[str]
    better: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]

    def best(self, rows: DataFrame) -> DataFrame:
        """The rows that no other one is better than, by one grouping.  A group holds the states of one key, so its
        size follows the number of states and not the table."""
        together, apart = self._columns(tuple(c for c in rows.columns if c not in self.on))
        return rows.groupBy(*self.on).agg(together).select(*self.on, apart).select(*rows.columns)

    @functools.cache  # noqa: B019  (an order lives as long as its fixpoint)
    def _columns(self, states: tuple[str, ...]) -> tuple[Column, Column]:
        beaten = lambda x: F.exists("_states", lambda y: (y != x) & self.better(lambda c: y[c], lambda c: x[c]))
        return F.collect_set(F.struct(*states)).alias("_states"), F.inline(F.filter("_states", lambda x: ~beaten(x)))

    @functools.cached_property
    def _covers(self) -> Column:
        same = reduce(lambda a, b: a & b, (F.col(f"n.{c}") == F.col(f"k.{c}") for c in self.on))
        return same & self.better(lambda c: F.col(f"k.{c}"), lambda c: F.col(f"n.{c}"))

    def beyond(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """The rows that no known one is at least as good as."""
        return rows.alias("n").join(known.alias("k"), self._covers, "left_anti").select(*rows.columns)


@dataclass
class Round:
    """What a round found: ``count`` new rows, ``new``, all rows ``known``, and what it settled (with ``settle``)."""

    number: int
    count: int
    new: DataFrame
    known: DataFrame
    settled: DataFrame | None = None


def advance(
    seed: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    rounds: int | None = None,
    keys: Sequence[str] | None = None,
    order: Order | None = None,
    settle: tuple[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> Iterator[Round]:
    """The rounds of ``least_fixpoint``, one at a time; the last one has no new rows.

    ``settle`` names a column and gives, from a round's new rows, the values of it (a table of that column)
    that need no more rows: these take no part in later rounds.
    """
    spark, columns = seed.sparkSession, seed.columns
    keys = list(keys or columns)
    rounds = rounds or int(spark.conf.get("weft.fixpoint.rounds", "100000"))
    rest = [c for c in columns if c not in keys]
    tables = Tables(spark)
    schema = seed.schema

    def once(rows: DataFrame) -> DataFrame:
        if order is not None:
            return order.best(rows)
        if not rest:
            return rows.distinct()
        return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least")).select(*(F.col(c) if c in keys else F.col(f"_least.{c}").alias(c) for c in columns))

    def unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
        if order is not None:
            return order.beyond(rows, known)
        return rows.join(known.select(*keys), keys, "left_anti").select(*columns)

    path, count = tables.counted(once(seed))
    paths = [path]
    new = known = _apart(tables.read(schema, path))
    done: list[str] = []
    for number in range(rounds):
        settled = None
        if settle is not None and count:
            name, decided = settle
            values = decided(new).select(name).distinct()
            if done:
                values = values.join(tables.read(values.schema, *done), name, "left_anti")
            path, n = tables.counted(values)
            if n:
                done.append(path)
                settled = tables.read(values.schema, path)
                new = new.join(tables.read(values.schema, *done), name, "left_anti").select(*columns)
        yield Round(number, count, new, known, settled)
        if not count:
            return
        found = unknown(once(step(new, known).select(*columns)), known)
        path, count = tables.counted(found)
        new = _apart(tables.read(schema, path))
        if count:
            paths.append(path)
            known = _apart(tables.read(schema, *paths))
        if len(paths) > MERGE:
            merged = tables.write(known if order is None else order.best(known))
            tables.drop(*paths[:-1])  # the last one is still read as new
            paths = [merged]
            known = _apart(tables.read(schema, *paths))
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def least_fixpoint(
    seed: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    stop: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int | None = None,
    keys: Sequence[str] | None = None,
    report: Callable[[int, int], None] | None = None,
    order: Order | None = None,
) -> DataFrame:
    """All rows derivable from ``seed`` by ``step(new, all)``, as a set.

    ``step`` gives rows with the columns of ``seed`` that use at least one new row.  Every round
    is written to the shared folder, so plans stay short and no executor's loss repeats earlier
    rounds.  With ``stop`` the loop ends early once that filter of the new rows has a row.  With
    ``keys`` rows that agree in these are one: the least of the round that found it first stays.  With
    ``order`` only rows that no other makes needless go on; some that are needless may be in the result.
    ``rounds`` (else the session's ``weft.fixpoint.rounds``, else 100,000) guards against a ``step`` that
    never ends: beyond it the call fails.  ``report`` is called with each round's number and new rows, and may raise to end the loop.
    Null never equals null in the comparison with earlier rows, so columns must not be null.
    """
    for found in advance(seed, step, rounds, keys, order):
        if report is not None:
            report(found.number, found.count)
        if stop is not None and found.count and not stop(found.new).isEmpty():
            break
    return found.known


def buckets(rows: int) -> int:
    """Into how many buckets the tables of a fixpoint over so many rules or edges are dealt."""
    return max(1, -(-rows // BUCKET))


def spread_bits(seed: DataFrame, step: Callable[[DataFrame], DataFrame], on: Sequence[str], rounds: int | None = None, parts: int | None = None, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """The least table of bit sets (columns ``on`` and bits, a bigint) that holds ``seed`` and what ``step`` gives: rows that
    agree in ``on`` are one, with all their bits.  ``step`` gets all rows, with a column fresh of the bits that the last round
    added, and gives at least the rows that use one of these.  A round reads one table and writes the next.

    With ``parts`` these tables are dealt into as many buckets by the first column of ``on``: if ``step`` joins them by it with
    tables that are dealt alike (``Tables.dealt``), a round moves nothing but what ``step`` gives.  ``report`` as in ``least_fixpoint``."""
    spark, on = seed.sparkSession, list(on)
    rounds = rounds or int(spark.conf.get("weft.fixpoint.rounds", "100000"))
    tables = Tables(spark)
    placed = lambda rows: rows if parts is None else rows.repartition(parts, on[0])
    merged = lambda rows, sums: placed(rows).groupBy(*on).agg(sums)
    none, fresh = F.lit(0).cast("bigint"), F.count_if(F.col("fresh") != 0)
    # columns go by name and are made once: a round only joins and selects
    both, new, more = F.coalesce("bits", none), F.coalesce("more", none), F.bit_or("bits").alias("more")
    grown = [*on, both.bitwiseOR(new).alias("bits"), new.bitwiseAND(F.bitwise_not(both)).alias("fresh")]

    def kept(rows: DataFrame) -> tuple[DataFrame, int, str]:
        if parts is None:
            path, count = tables.counted(rows, fresh)
            return tables.read(rows.schema, path), count, path
        return *tables.dealt(rows, on[0], parts, fresh), f"{tables.root}/{tables.count}"

    rows = merged(seed, F.bit_or("bits").alias("bits")).select(*on, F.coalesce("bits", none).alias("bits"), F.coalesce("bits", none).alias("fresh"))
    found, count, path = kept(rows)
    for number in range(rounds):
        if report is not None:
            report(number, count)
        state = _apart(found)
        if not count:
            return state.select(*on, "bits")
        now = state.drop("fresh").join(merged(step(state), more), on, "full").select(*grown)
        last = path
        found, count, path = kept(now)
        tables.drop(last)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
