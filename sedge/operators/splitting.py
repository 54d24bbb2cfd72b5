"""Reproducible train / test / validation split."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sedge.operators.quantiles import INSIDE, value_at

HASH_DIGITS = 13  # 52 bits: exact in a long and in a double


def row_hash(id_columns: Sequence[str], seed: int) -> Column:
    """Uniform long below 16**13 from the row's id, the same in any engine with MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in id_columns])
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("long")


def _share(total: float) -> int:
    return round(total * 16**HASH_DIGITS)


def hash_split(
    df: DataFrame,
    id_columns: Sequence[str],
    holdout: float = 0.2,
    train_within: float = 0.8,
    seed: int = 42,
    exact: bool = False,
    name: str = "split",
    inside: int = INSIDE,
) -> DataFrame:
    """Add ``train``, ``test`` or ``validation``: holdout first, then the inner split.

    The split is a function of the row's id, so it needs no shuffle and survives
    retries and appends. Sizes are binomial around the fractions; ``exact`` takes
    the ceil-sized counts by hash rank and needs distinct ids.
    """
    h = row_hash(id_columns, seed)
    if exact:
        hashes = df.select(h.alias("h"))
        n = hashes.count()
        n_val = math.ceil(holdout * n)
        n_test = math.ceil((1 - train_within) * (n - n_val))
        first_beyond = lambda k: value_at(hashes, "h", k, inside) if k < n else 16**HASH_DIGITS
        cut_val, cut_test = F.lit(first_beyond(n_val)), F.lit(first_beyond(n_val + n_test))
    else:
        cut_val = F.lit(_share(holdout))
        cut_test = F.lit(_share(holdout + (1 - holdout) * (1 - train_within)))
    return df.withColumn(
        name,
        F.when(h < cut_val, "validation").when(h < cut_test, "test").otherwise("train"),
    )


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("rows"))
