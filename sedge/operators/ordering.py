"""Ordered computations over series of any length.

A window whose partition is one key (or no key at all) puts the whole series in
one task. Here the order columns are cut into as many ranges as the session has shuffle
partitions, at every size; windows run inside ``(key, range)``, and a small table with one row per
``(key, range)`` carries the state from range to range. The cut points come from
a bounded sample, but they are literals in the plan: a lost task finds the same
ranges again, and a poor sample costs balance, never correctness.

Order columns must be numeric and should be unique within a key; put a second
column behind one with ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_RANGES = 4096
SAMPLES_PER_RANGE = 32


def order_cuts(
    df: DataFrame,
    order: Sequence[str],
    ranges: int | None = None,
    rows: int | None = None,
) -> list[tuple]:
    """Cut points over the order columns for ``ranges`` ranges, by default one per shuffle partition.

    At most ``MAX_RANGES * SAMPLES_PER_RANGE`` sampled rows reach the driver.
    """
    ranges = min(MAX_RANGES, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = df.count() if rows is None else rows
    share = min(1.0, ranges * SAMPLES_PER_RANGE / max(total, 1))
    drawn = df.select(*order).na.drop().sample(share, seed=11).limit(2 * ranges * SAMPLES_PER_RANGE)
    sample = sorted(tuple(r) for r in drawn.collect())
    if not sample:
        return []
    picked = (sample[i * len(sample) // ranges] for i in range(1, ranges))
    return list(dict.fromkeys(picked))


def with_range(df: DataFrame, order: Sequence[str], cuts: Sequence[tuple], name: str = "_range") -> DataFrame:
    """Number of cut points at or below the row, found by bisection in one expression."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    point = lambda values: F.struct(*[v.cast(kinds[c]).alias(c) for c, v in zip(order, values)])
    array = F.array(*[point([F.lit(v) for v in cut]) for cut in cuts])
    row = point([F.col(c) for c in order])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def advance(found: Column, step: Column) -> Column:
        probe = found + step
        below = F.element_at(array, F.least(probe, F.lit(len(cuts)))) <= row
        return F.when((probe <= len(cuts)) & below, probe).otherwise(found)

    return df.withColumn(name, F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> tuple[Column, DataFrame]:
    """NULL-safe join condition on ``names`` and the right side with its keys renamed."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(renamed[f"_r_{n}"])
    return condition, renamed


def join_keys(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join that also pairs NULL keys, keeping one copy of them."""
    condition, renamed = _same(left, right, names)
    return left.join(renamed, condition, how).drop(*[f"_r_{n}" for n in names])


MAX_LOCAL_GROUPS = 10_000


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-group statistics, NULL keys included.

    Up to ``MAX_LOCAL_GROUPS`` groups are fetched and sent along with the plan,
    so a large table with a handful of groups is never shuffled by them. With
    more groups it is an ordinary join.
    """
    few = stats.limit(MAX_LOCAL_GROUPS + 1).collect()
    if len(few) > MAX_LOCAL_GROUPS:
        return join_keys(df, stats, keys)
    return join_keys(df, F.broadcast(df.sparkSession.createDataFrame(few, stats.schema)), keys)


def running_total(
    df: DataFrame,
    value: Column | str,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    cuts: Sequence[tuple] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add the cumulative sum of ``value`` per key in the given order."""
    cuts = order_cuts(df, order, ranges) if cuts is None else cuts
    df = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not cuts:
        return df.withColumn(name, F.sum("_value").over(upto(*keys))).drop("_value")
    cells = [*keys, "_range"]
    rows = with_range(df, order, cuts)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*cells)
        .agg(F.sum("_value").alias("_sum"))
        .select(*cells, F.sum("_sum").over(before).alias("_carried"))
    )
    local = rows.withColumn("_local", F.sum("_value").over(upto(*cells)))
    total = F.col("_local") + F.coalesce(F.col("_carried"), F.lit(0).cast(carried.schema["_carried"].dataType))
    return (
        join_keys(local, carried, cells)
        .withColumn(name, total)
        .drop("_value", "_local", "_carried", "_range")
    )


def previous_value(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    cuts: Sequence[tuple] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``struct(value)`` of the row before, per key; NULL struct on the first row."""
    cuts = order_cuts(df, order, ranges) if cuts is None else cuts
    boxed = F.struct(F.col(value).alias("value"))
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.lag(boxed).over(w))
    cells = [*keys, "_range"]
    rows = with_range(df, order, cuts)
    last = F.max_by(boxed, F.struct(*order)).alias("_last")
    before = Window.partitionBy(*keys).orderBy("_range")
    carried = (
        rows.groupBy(*cells).agg(last).select(*cells, F.lag("_last").over(before).alias("_carried"))
    )
    inner = F.lag(boxed).over(Window.partitionBy(*cells).orderBy(*order))
    return (
        join_keys(rows.withColumn("_inner", inner), carried, cells)
        .withColumn(name, F.coalesce("_inner", "_carried"))
        .drop("_inner", "_carried", "_range")
    )


def positions(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    keys: Sequence[str] = (),
    ranges: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add a dense 0-based position per key: gap-free ids without a one-task window."""
    cuts = order_cuts(df, order, ranges, rows)
    ranked = running_total(df, F.lit(1).cast("long"), keys, order, name, cuts)
    return ranked.withColumn(name, F.col(name) - 1)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by the order columns; aggregates map-side, so no key has to fit a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])
