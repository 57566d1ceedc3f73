"""Ordered and grouped work that stays spread out when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here rows are parted by ranges of
(key, order), so that a key of any size lies in as many neighbouring ranges as its number of rows
asks for, whatever the gaps in the order column. Each range's stretch of a key is one window partition;
the stretches' totals, at most one per key and range, are combined by a second, small window, and the
combined value is added back. For rows that are written already, and so cheap to read again, the bounds of the ranges are found from a sample: the range
of a row is then a matter of its own values, and rows are shuffled once, by key and range. Others are dealt by ranges and written.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastro.functions.basic import let
from rastro.session import settle

DEFAULT_SPAN = 100_000
BLOCK = "__block"
#: Rows sampled per range, which go through the driver, and bounds that are looked at in one step.
SAMPLED, STEP = 30, 16


def _local(kind: str, c: Column, w) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min,
            "last": lambda x: F.last(x, ignorenulls=True)}[kind](c).over(w)


def _total(kind: str, c: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c)


def _combine(kind: str, before: Column, here: Column) -> Column:
    return {"sum": lambda: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
            "max": lambda: F.greatest(before, here), "min": lambda: F.least(before, here),
            "last": lambda: F.coalesce(here, before)}[kind]()


def range_of(df: DataFrame, keys: list[str], order: str) -> Column:
    """The number of the range of (keys, order) that a row lies in: as many ranges as a shuffle begins with, of about equal numbers of rows.

    The bounds are taken from a sample of some rows per range and become a constant; any bounds give right results.
    """
    conf = df.sparkSession.conf
    ranges = max(int(conf.get("spark.sql.shuffle.partitions")), int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0))
    at = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*keys, order])])
    sample = df.select(at.alias("at")).orderBy(F.xxhash64("at")).limit(SAMPLED * ranges)
    places = F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda i: F.get("all", F.floor(i * F.size("all") / ranges).cast("int")))
    found = sample.agg(F.sort_array(F.collect_list("at")).alias("all")).select(F.filter(F.array_distinct(places), lambda x: x.isNotNull()).alias("bounds"))
    bounds, kind = json.loads(found.select(F.to_json("bounds")).first()[0])[1:], found.schema["bounds"].dataType.simpleString()
    array = lambda part: F.from_json(F.lit(json.dumps(part)), kind)
    passed = lambda some, row: F.size(F.filter(some, lambda b: b <= row))
    if len(bounds) <= 2 * STEP:
        return let(at, lambda row: passed(array(bounds), row))
    steps = lambda row: passed(array(bounds[STEP - 1::STEP]), row) * STEP
    return let(at, lambda row: let(steps(row), lambda n: n + passed(F.slice(array(bounds), n + 1, F.lit(STEP)), row)))


def dealt_by_ranges(df: DataFrame, keys: list[str], order: str, work=lambda rows: rows) -> DataFrame:
    """The rows dealt by ranges of (keys, order) and written once, so that all who read them see the same ranges.

    ``running`` takes such rows as they are, as long as the column of the ranges stays with them, for the same order and any keys
    that begin with these and never fall along it. ``work`` is done on the dealt rows: finding the ranges looks at all rows once
    more, which should not repeat what is costly. Rows that several running values follow should be dealt so: neighbours that lie together make all
    later shuffles smaller.
    """
    return settle(work(df.repartitionByRange(*keys, order)).withColumn(BLOCK, F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, Column]],
            span: int | None = DEFAULT_SPAN, written: bool = False) -> DataFrame:
    """Add running values per key.

    ``specs`` maps an output column to (kind, expression); kinds are ``sum``, ``max``, ``min`` and
    ``last`` (the last value that is not NULL), up to and including the row, or, with a trailing
    ``<``, up to the row before it. ``order`` is an integer column, unique within the keys. ``span=None``
    says that the rows of a key are known to fit one task (they came out of one input row) and uses one
    plain window; with any number the rows are parted by ranges. Without keys there is one running
    value over all rows, and the offsets of the ranges, one row each, pass through the driver.
    ``written`` says that the rows are read from where they were written, so they need not be written again.
    """
    kinds = {n: k.rstrip("<") for n, (k, _) in specs.items()}
    ends = {n: -1 if k.endswith("<") else 0 for n, (k, _) in specs.items()}
    parts = keys if span is None else [*keys, BLOCK]
    hidden = {f"__v_{n}": e for n, (_, e) in specs.items()}
    base = local = df.withColumns(hidden)
    if span is not None and BLOCK not in df.columns:
        dealt = df.withColumn(BLOCK, range_of(df, keys, order)) if written else dealt_by_ranges(df, keys, order)
        # Dealt here and not by the window, so that the expressions are worked out behind the shuffle and do not go through it.
        base, local = dealt.withColumns(hidden), dealt.repartition(*parts).withColumns(hidden)
    w = Window.partitionBy(*parts).orderBy(order)
    local = local.withColumns({n: _local(kinds[n], F.col(f"__v_{n}"), w.rowsBetween(Window.unboundedPreceding, ends[n])) for n in specs})
    if span is None:
        zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in specs if kinds[n] == "sum"}
        return local.withColumns(zero).select(*df.columns, *specs)

    totals = base.groupBy(*parts).agg(*[_total(kinds[n], F.col(f"__v_{n}"), F.col(order)).alias(f"__t_{n}") for n in specs])
    if keys:
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*parts, *[_local(kinds[n], F.col(f"__t_{n}"), before).alias(f"__c_{n}") for n in specs])
    else:
        carried = _carried_over_all(totals, specs, kinds)
    # A first block carries nothing in, so the table joined back holds only keys that span blocks.
    carried = carried.filter(reduce(lambda a, b: a | b, [F.col(f"__c_{n}").isNotNull() for n in specs]))
    out = local.join(carried, parts, "left")
    out = out.withColumns({n: _combine(kinds[n], F.col(f"__c_{n}"), F.col(n)) for n in specs})
    return out.select(*df.columns, *specs)


def _carried_over_all(totals: DataFrame, specs: dict, kinds: dict[str, str]) -> DataFrame:
    """What the ranges before each one carry into it. There is one row per range."""
    fold = {"sum": lambda a, b: (a or 0) + (b or 0), "max": lambda a, b: b if a is None else a if b is None else max(a, b),
            "min": lambda a, b: b if a is None else a if b is None else min(a, b), "last": lambda a, b: a if b is None else b}
    rows, held = [], {n: None for n in specs}
    for r in sorted(totals.collect(), key=lambda r: r[BLOCK]):
        rows.append((r[BLOCK], *[held[n] for n in specs]))
        held = {n: fold[kinds[n]](held[n], r[f"__t_{n}"]) for n in specs}
    types = ", ".join(f"__c_{n} {totals.schema[f'__t_{n}'].dataType.simpleString()}" for n in specs)
    return totals.sparkSession.createDataFrame(rows, f"{BLOCK} int, {types}")


def numbered(df: DataFrame, keys: list[str], order: str, out: str, span: int = DEFAULT_SPAN, written: bool = False) -> DataFrame:
    """Number the rows of each key 1..n by an integer order column."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("bigint"))}, span, written)


def numbered_any(df: DataFrame, keys: list[str], row_id: str, out: str) -> DataFrame:
    """Number the rows of each key 1..n in the order of their unique ``row_id``, of any type."""
    return running(df, keys, row_id, {out: ("sum", F.lit(1).cast("bigint"))})


def first_by(df: DataFrame, keys: list[str], order, value: Column | None = None) -> DataFrame:
    """The first row of each key, by partial aggregation instead of a ranking window."""
    cols = [c for c in df.columns if c not in keys]
    row = F.struct(*cols) if value is None else value
    return (df.groupBy(*keys).agg(F.min_by(row, order).alias("__row"))
            .select(*keys, "__row.*"))


def last_by(df: DataFrame, keys: list[str], order) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("__row")).select(*keys, "__row.*")
