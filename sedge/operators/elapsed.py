"""Elapsed seconds from a wall clock that wraps, resets or drops readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sedge.functions.numbers import clock_seconds
from sedge.operators.ordering import join_keys, order_cuts, previous_value, running_total
from sedge.operators.quantiles import grouped_quantile
from sedge.session import materialized

MAX_UNREADABLE = 0.95


def elapsed_seconds(
    df: DataFrame,
    clock: str,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "time_s",
    default_step: float = 15.0,
    minute_form: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add seconds since the first row of each series.

    A step that is not positive, or that lacks one of its two readings, counts
    as the median positive step of the series (``default_step`` if it has none).
    Raises when more than 95 % of the readings cannot be read.
    """
    timed = df.withColumn("_t", clock_seconds(clock, minute_form))
    seen = timed.agg(F.count("*").alias("rows"), F.count("_t").alias("read")).first()
    if seen["rows"] and 1 - seen["read"] / seen["rows"] > MAX_UNREADABLE:
        bad = [r[0] for r in timed.where("_t is null").select(clock).limit(10).collect()]
        raise ValueError(f"over 95% of clock readings cannot be parsed, such as {bad}")

    cuts = order_cuts(df, order, ranges, seen["rows"])
    behind = previous_value(timed, "_t", keys, order, "_prev", cuts)
    step = F.col("_t") - F.col("_prev.value")
    # The median and both passes of the running total read the steps.
    stepped = materialized(behind.withColumn("_step", F.when(step > 0, step)), "steps")

    typical = grouped_quantile(stepped, "_step", 0.5, keys, "_usual", ranges)
    if keys:
        filled = join_keys(stepped, typical, keys)
    else:
        filled = stepped.withColumn("_usual", typical.select("_usual").scalar())
    move = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(
        F.coalesce("_step", "_usual", F.lit(float(default_step)))
    )
    total = running_total(filled, move, keys, order, name, cuts)
    return total.drop("_t", "_prev", "_step", "_usual")
