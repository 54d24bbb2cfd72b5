"""Cleaning and checking of raw and prepared sensor tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.numbers import to_number
from sedge.operators.elapsed import elapsed_seconds
from sedge.operators.splitting import hash_split


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce columns to double; what is no number becomes NULL."""
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})


def usable_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Drop rows without target or without any feature."""
    return df.where(_usable(features, target))


def _usable(features: Sequence[str], target: str) -> Column:
    some = F.coalesce(*[F.col(f"`{c}`") for c in features]) if features else F.lit(None)
    return F.col(f"`{target}`").isNotNull() & some.isNotNull()


def cleaning_report(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row: rows before, after and dropped."""
    kept = F.count_if(_usable(features, target))
    return df.agg(
        F.count("*").alias("rows_before_clean"),
        kept.alias("rows_after_clean"),
        (F.count("*") - kept).alias("rows_dropped"),
    )


def _problems(df: DataFrame, found: Sequence[tuple[Column, str, Column]]) -> DataFrame:
    """One row of aggregates -> the rows ``(rule, detail)`` whose test holds."""
    each = [
        F.when(test, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
        for test, rule, detail in found
    ]
    return df.select(F.explode(F.array_compact(F.array(*each))).alias("p")).select("p.rule", "p.detail")


def raw_problems(df: DataFrame, required: Sequence[str] = (), min_rows: int = 1) -> DataFrame:
    """Problems of a raw table as rows ``(rule, detail)``; no rows means valid. One pass."""
    names = df.columns
    repeated = [n for i, n in enumerate(names) if n in names[:i]]
    missing = [c for c in required if c not in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    some = F.lit(False)
    for c in plain.columns:
        some = some | F.col(c).isNotNull()
    facts = plain.agg(F.count("*").alias("n"), F.count_if(some).alias("filled"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return _problems(
        facts,
        [
            (
                F.col("n") < min_rows,
                "too_few_rows",
                text("Too few rows: ", F.col("n").cast("string"), f" < {min_rows}."),
            ),
            *[
                (F.lit(True), "missing_column", F.lit(f"Missing required column: {c!r}."))
                for c in missing
            ],
            (
                F.lit(bool(repeated)),
                "duplicate_columns",
                F.lit(f"Duplicate column names: {repeated}."),
            ),
            (F.col("filled") == 0, "all_empty", F.lit("All rows are entirely empty.")),
        ],
    )


def prepared_problems(
    df: DataFrame, features: Sequence[str], target: str, split: str = "split"
) -> DataFrame:
    """Problems of a prepared table: empty table or split, NULL target, no features."""
    n = lambda s: F.count_if(F.col(split) == s)
    facts = df.agg(
        F.count("*").alias("n"),
        n("train").alias("train"),
        n("test").alias("test"),
        n("validation").alias("val"),
        F.count_if(F.col(f"`{target}`").isNull()).alias("unlabeled"),
    )
    empty = [
        (F.col(s) == 0, "empty_split", F.lit(f"Empty {s} split.")) for s in ("train", "test", "val")
    ]
    return _problems(
        facts,
        [
            (F.col("n") == 0, "empty_frame", F.lit("Prepared frame is empty after cleaning.")),
            *empty,
            (F.col("unlabeled") > 0, "null_target", F.lit("Target contains NaN after cleaning.")),
            (F.lit(not features), "no_features", F.lit("No feature columns selected.")),
        ],
    )


@dataclass
class Prepared:
    """Cleaned and split rows with the names of their feature and target columns."""

    df: DataFrame
    features: list[str]
    target: str
    report: DataFrame


def prepare(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    id_columns: Sequence[str],
    clock: str | None = None,
    order: Sequence[str] = (),
    keys: Sequence[str] = (),
    holdout: float = 0.2,
    train_within: float = 0.8,
    seed: int = 42,
    exact: bool = False,
) -> Prepared:
    """Clock to seconds, numbers coerced, unusable rows out, rest split.

    Elapsed time is built before any row is dropped, so a dropped row still
    counts as a step of its series.
    """
    wanted = [*features, target, *([clock] if clock else [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}; available: {df.columns}")
    used = [c for c in features if c != clock]
    work = elapsed_seconds(df, clock, order, keys) if clock else df
    if clock:
        used = ["time_s", *used]
    numbers = numeric_columns(work, [c for c in [*used, target] if c != "time_s" or not clock])
    carried = list(dict.fromkeys([*id_columns, *keys, *used, target]))
    numbers = numbers.select(*[F.col(f"`{c}`") for c in carried])
    split = hash_split(usable_rows(numbers, used, target), id_columns, holdout, train_within, seed, exact)
    return Prepared(split, used, target, cleaning_report(numbers, used, target))
