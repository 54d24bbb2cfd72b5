"""Incremental document snapshot: landed raw records -> one document per id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sedge.operators.ordering import first_rows


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as written so far; empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


BUCKETS = 256


def first_wins_sink(path: str, ids: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps the first row per id across all batches.

    Rows are stored by a hash bucket of their id. Each batch drops ids of earlier batches by an anti join on the
    id columns alone, with the buckets it touches and no others, and writes only its own ``batch=<n>`` folder, in
    overwrite mode: a batch that is replayed after a failure replaces itself, and what is already
    written is never rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*ids), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        fresh = first_rows(batch, ids, order).withColumn("bucket", bucket)
        stored = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        known = read_table(spark, path, stored)
        earlier = known.where((F.col("batch") < number) & F.col("bucket").isin(touched)).select("bucket", *ids)
        kept = fresh.join(earlier, ["bucket", *ids], "left_anti")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return write


def refresh(
    arriving: DataFrame,
    path: str,
    checkpoint: str,
    ids: list[str],
    order: list[str],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the merge of a stream into the table at ``path``; by default it stops once all is read."""
    return (
        arriving.writeStream.foreachBatch(first_wins_sink(path, ids, order))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def landed_json(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of JSON-lines files as they land, with their landing time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return stream.withColumn("_landed", F.col("_metadata.file_modification_time"))


def deduplicated(arriving: DataFrame, ids: list[str], event_time: str, delay: str) -> DataFrame:
    """Stream with one row per id within the watermark; state older than the delay is dropped."""
    return arriving.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(ids)
