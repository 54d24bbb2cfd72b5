"""Exact, interpolated quantiles at any row count."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sedge.functions.numbers import finite_or_null
from sedge.operators.ordering import join_keys, running_total

ACCURACY = 10_000
# Distinct values that one bracket's exact step keeps in memory at most.
INSIDE = 100_000


def _brackets(df: DataFrame, spots: Sequence[tuple[str, float]], counts: dict[str, int], most: int) -> list[tuple]:
    """For each (column, 0-based rank) a value range that holds the ranks beside it: ``(low, high, rows below, rows inside)``.

    Each round asks for approximate percentiles of all columns in one pass and counts all brackets in a second one. A
    round leaves some thousandth of a bracket's rows, and rounds go on until few are left or one value is.
    """
    state = [(float("-inf"), float("inf"), 0, counts[c]) for c, _ in spots]
    fixed: set[int] = set()
    while todo := [k for k, s in enumerate(state) if k not in fixed and s[3] > most and s[0] < s[1]]:
        edges = []
        for k in todo:
            (c, spot), (low, high, below, inside) = spots[k], state[k]
            first, last = (math.floor(spot) - below) / inside, (math.ceil(spot) + 1 - below) / inside
            at = [max(0.0, first - 2 / ACCURACY), min(1.0, last + 2 / ACCURACY)]
            held = F.when(F.col(c).between(low, high), F.col(c))
            edges.append(F.percentile_approx(held, at, ACCURACY).alias(f"p{k}"))
        found = df.agg(*edges).first()
        asked = [F.count_if(F.col(spots[k][0]) < found[f"p{k}"][0]).alias(f"b{k}") for k in todo]
        asked += [F.count_if(F.col(spots[k][0]).between(*found[f"p{k}"])).alias(f"i{k}") for k in todo]
        seen = df.agg(*asked).first()
        for k in todo:
            new = (*found[f"p{k}"], seen[f"b{k}"], seen[f"i{k}"])
            holds = new[2] <= math.floor(spots[k][1]) and math.ceil(spots[k][1]) < new[2] + new[3]
            if not holds or new[3] == state[k][3]:
                fixed.add(k)
            if holds:
                state[k] = new
    return state


def quantiles(
    df: DataFrame, columns: Sequence[str], at: Sequence[float], inside: int = INSIDE
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of several columns as driver values, exact at any size.

    Ranks are bracketed until at most ``inside`` rows are left between, and those are ranked exactly, all
    columns in one pass.
    """
    clean = df.select(*[finite_or_null(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    names = clean.columns
    counts = clean.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    spots = [(n, q * (counts[n] - 1)) for n in names if counts[n] for q in at]
    if not spots:
        return {c: [None] * len(at) for c in columns}
    ranked = []
    for k, ((n, spot), (low, high, below, held)) in enumerate(zip(spots, _brackets(clean, spots, counts, inside))):
        share = (spot - below) / (held - 1) if held > 1 else 0.0
        value = F.when(F.col(n).between(low, high), F.col(n))
        ranked.append(F.percentile(value, F.lit(float(min(max(share, 0.0), 1.0)))).alias(f"q{k}"))
    row = iter(clean.agg(*ranked).first())
    return {c: [next(row) if counts[n] else None for _ in at] for c, n in zip(columns, names)}


def value_at(df: DataFrame, column: str, rank: int, inside: int = INSIDE) -> float | None:
    """The value at 0-based ``rank`` among the non-NULL values of a numeric column."""
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    n = values.count()
    if not 0 <= rank < n:
        return None
    ((low, high, below, _),) = _brackets(values, [("v", float(rank))], {"v": n}, inside)
    kept = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    ranked = running_total(kept, "n", [], ["v"], "upto")
    return ranked.where(F.col("upto") > rank - below).agg(F.min("v")).first()[0]


def grouped_quantile(
    df: DataFrame, value: str, at: float, keys: Sequence[str], name: str, ranges: int | None = None
) -> DataFrame:
    """Interpolated quantile per key.

    Equal values are counted map-side first. The ranks come from a running count cut into ranges, so
    a key with more distinct values than a task can hold is fine.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counted, "_n", keys, [value], "_upto", ranges=ranges)
    spot = (F.col("_all") - 1) * F.lit(float(at))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    bounds = (
        join_keys(ranked, totals, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_upto") > F.floor(spot), F.col(value))).alias("_lo"),
            F.min(F.when(F.col("_upto") > F.ceil(spot), F.col(value))).alias("_hi"),
            F.first(spot - F.floor(spot)).alias("_part"),
        )
    )
    exact = F.col("_lo") + (F.coalesce("_hi", "_lo") - F.col("_lo")) * F.col("_part")
    return bounds.select(*keys, exact.alias(name))
