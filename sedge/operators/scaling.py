"""Min-max scaling over a table or per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.numbers import finite_or_null, is_flat
from sedge.operators.ordering import attach

Bounds = Mapping[str, tuple[float, float]]


def _box(name: str, low: Column, high: Column) -> list[Column]:
    """Fields by which ``name`` is scaled: where it starts, how far it goes, whether it is flat."""
    flat = is_flat(low, high)
    return [
        low.alias(f"{name}_lo"),
        F.when(flat, 1.0).otherwise(high - low).alias(f"{name}_span"),
        flat.alias(f"{name}_flat"),
    ]


def with_bounds(df: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Add a struct ``_bounds`` that :func:`by_bounds` scales each of the named values with.

    All values share one pass. Without keys the bounds are one scalar subquery,
    with keys one row per group.
    """
    fields = []
    for name, x in values.items():
        x = finite_or_null(x)
        fields += _box(name, F.min(x), F.max(x))
    if not keys:
        return df.withColumn("_bounds", df.agg(F.struct(*fields).alias("b")).scalar())
    return attach(df, df.groupBy(*keys).agg(F.struct(*fields).alias("_bounds")), keys)


def fixed_bounds(df: DataFrame, bounds: Bounds) -> DataFrame:
    """``_bounds`` from known numbers, as a stream needs them."""
    fields = []
    for name, (low, high) in bounds.items():
        fields += _box(name, F.lit(low).cast("double"), F.lit(high).cast("double"))
    return df.withColumn("_bounds", F.struct(*fields))


def by_bounds(name: str, x: Column) -> Column:
    """``(x - low) / (high - low)`` by the bounds of ``name``; 0 on every row when they are flat."""
    of = lambda part: F.col(f"_bounds.{name}_{part}")
    return F.when(of("flat"), 0.0).otherwise((finite_or_null(x) - of("lo")) / of("span"))


def minmax(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), suffix: str = "_n") -> DataFrame:
    """Add ``<column>_n`` in 0..1; a flat column gives zeros."""
    values = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}
    out = with_bounds(df, values, keys)
    return out.withColumns(
        {f"{c}{suffix}": by_bounds(f"c{i}", F.col(f"`{c}`")) for i, c in enumerate(columns)}
    ).drop("_bounds")


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add ``<column>_z`` with population deviation; a flat column is only centred, NaN becomes NULL."""
    number = {c: finite_or_null(F.col(f"`{c}`")) for c in columns}
    stats = df.agg(
        F.struct(
            *[F.avg(number[c]).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(number[c]).alias(f"s{i}") for i, c in enumerate(columns)],
        ).alias("s")
    ).scalar()
    out = df.withColumn("_stats", stats)
    spread = lambda i: F.when(F.col(f"_stats.s{i}") > 0, F.col(f"_stats.s{i}")).otherwise(1.0)
    return out.withColumns(
        {f"{c}{suffix}": (number[c] - F.col(f"_stats.m{i}")) / spread(i) for i, c in enumerate(columns)}
    ).drop("_stats")
