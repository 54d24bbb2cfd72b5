"""Stream queries: the events and line items are read as streams until they are used up."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.operators.proxies import fixed_drivers, training_bounds
from sedge.plans.registry import Registry, table
from sedge.plans.sensor import ROWS, _scaled
from sedge.session import scratch_path
from sedge.streaming.refresh import refresh
from sedge.streaming.scoring import score_stream

registry = Registry()


def as_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@registry.query(
    """SELECT user_id % 40 AS id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id % 3, event_id) = 1"""
)
def landed_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Events that land in three parts, each merged into what came before."""
    out, checkpoint, landing = (scratch_path(spark, f"landed{n}") for n in ("", "-state", "-files"))
    events = table(spark, sf, "events").select((F.col("user_id") % 40).alias("id"), "event_id", "event_type", "value")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(landing)
        arriving = spark.readStream.schema(events.schema).parquet(landing)
        refresh(arriving, out, checkpoint, ["id"], ["event_id"]).awaitTermination()
    return spark.read.parquet(out).drop("batch", "bucket")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("time_s"),
        (F.col("l_discount") * 100 + F.col("l_quantity") * 0.2).alias("temperature"),
        F.col("l_tax").alias("stiring"), F.col("l_extendedprice").alias("y"),
    )


def line_model(rows: DataFrame) -> PipelineModel:
    """Straight line from time to the target, ending in ``y_pred``."""
    stages = [
        VectorAssembler(inputCols=["time_s"], outputCol="_x"),
        LinearRegression(featuresCol="_x", labelCol="y"),
        SQLTransformer(statement="SELECT *, prediction AS y_pred FROM __THIS__"),
    ]
    return Pipeline(stages=stages).fit(rows)


@registry.query(
    f"""WITH {ROWS}, fit AS (SELECT regr_slope(y, t) AS a, regr_intercept(y, t) AS b FROM base),
p AS (SELECT base.*, a * t + b AS yp FROM base, fit),
n AS (SELECT *, 4e-1 * {_scaled("t", "")} + 4e-1 * {_scaled("c", "")} + 2e-1 * {_scaled("s", "")} AS e, {_scaled("yp", "")} AS yn FROM p)
SELECT l_orderkey, l_linenumber, round(yp, 3) AS y_pred, round(e, 6) AS energy_proxy, round(7e-1 * e + 3e-1 * yn, 6) AS co2_proxy FROM n"""
)
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    training = _rows(table(spark, sf, "lineitem"))
    model = line_model(training)
    drivers = fixed_drivers(training.columns)
    bounds = training_bounds(model.transform(training), drivers=drivers)
    out, checkpoint = scratch_path(spark, "scores"), scratch_path(spark, "scores-state")
    scored = score_stream(_rows(as_stream(spark, sf, "lineitem")), model, bounds, drivers)
    kept = scored.select("l_orderkey", "l_linenumber", "y_pred", "energy_proxy", "co2_proxy")
    writer = kept.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select(
        "l_orderkey", "l_linenumber", F.round("y_pred", 3).alias("y_pred"),
        F.round("energy_proxy", 6).alias("energy_proxy"), F.round("co2_proxy", 6).alias("co2_proxy"),
    )
