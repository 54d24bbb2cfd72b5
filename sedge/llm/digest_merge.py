"""Exact duplicates by merging sorted runs of text digests in rounds.

Each partition of the table is a run: its distinct digests in order, with the identifier to
keep and a count. In every round ``fan_in`` neighbouring runs become one: they exchange their stretches of the digests' order, so that a
task holds the same stretch of all of them, sorted, and one walk over it merges equal digests. After log(runs) rounds one run is left, which stays
spread over the stretches. A text that a third of the rows hold enters a round at most once per run, however many rows share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.scratch import materialized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What makes two texts the same: the digest, checked by length and a second, independent hash.
PROOF = ["digest", "length", "check"]
# A stretch of the digests' order are those that begin with the same hexadecimal digits: 4,096 stretches.
STRETCH_DIGITS = 3


def folded(text: str | Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def digest_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, run, digest, length, check`` of every row, written once so that later reads see the same runs."""
    body = df.select(F.col(key).alias("key"), folded(text).alias("body"))
    rows = body.select(
        "key",
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"),
        F.octet_length("body").alias("length"),
        F.xxhash64("body").alias("check"),
    )
    return materialized(rows, "digests")


def merge_runs(runs: DataFrame, fan_in: int = 16, keep: str = "max") -> DataFrame:
    """One row per distinct text: ``PROOF``, ``keep``, ``n``.

    ``keep`` is ``"max"`` or ``"min"``: which identifier stays, decided anew at every level.
    Null identifiers lose against any other; if all are null, ``keep`` is null.
    """
    best, order = {"max": F.max, "min": F.min}[keep], ["run", "stretch", *PROOF]
    # A boxed identifier is merged in sorted order; without an identifier there is no box.
    boxed = F.when(F.col("key").isNotNull(), F.struct("key"))
    level = runs.withColumn("stretch", F.substring(F.hex("digest"), 1, STRETCH_DIGITS)).groupBy(*order).agg(best(boxed).alias("keep"), F.count("*").alias("n"))
    left = runs.agg(F.max("run")).first()[0]
    while left:
        met = level.withColumn("run", F.expr(f"run div {fan_in}")).repartition("run", "stretch").sortWithinPartitions(*order)
        level = met.groupBy(*order).agg(best("keep").alias("keep"), F.sum("n").alias("n"))
        left //= fan_in
    level = level.select(*PROOF, F.col("keep.key").alias("keep"), "n").withColumn("run", F.lit(0))
    return level.drop("run")


def exact_duplicates(df: DataFrame, key: str, text: str, fan_in: int = 16, keep: str = "max") -> DataFrame:
    """One row per row of ``df``: ``key, keep_id, group_size, kept, text_sha256``.

    Null and empty texts are one group. The identifier to keep is the largest (or smallest) of a group; rows that repeat an
    identifier within a group are told apart by nothing, so all rows with the kept one
    count as kept, and so do rows of a group without any identifier. Empty tables give no rows; other columns are not read, so
    their names cannot clash. The way back goes from the merged run to each first run (a text
    occurs there once) and then to the rows, whose hot texts are spread by run.
    """
    runs = digest_runs(df, key, text)
    merged = merge_runs(runs, fan_in, keep)
    own = runs.select("run", *PROOF).distinct()
    answers = own.join(merged, PROOF)
    return runs.join(answers, ["run", *PROOF]).select(
        F.col("key").alias(key),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("key").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def first_of_equals(df: DataFrame, key: str, text: str, keep: str = "max") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of rows that share the kept identifier and the text too, one.

    In a group without identifiers one row stays.
    """

    def place(key: Column, sha: Column) -> Column:
        return F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("none")), sha)

    found = exact_duplicates(df, key, text, keep=keep).filter(F.col(key).eqNullSafe(F.col("keep_id")))
    stays = found.select(place(F.col(key), F.col("text_sha256")).alias("_place"))
    own = df.withColumn("_place", place(F.col(key), F.sha2(folded(text).cast("binary"), 256)))
    return own.join(stays, "_place", "left_semi").dropDuplicates(["_place"]).drop("_place")
