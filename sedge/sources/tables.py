"""Readers and writers for sensor, literature and finder tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sedge.functions.lexicon import DEFAULT_KEYWORDS
from sedge.functions.numbers import to_number
from sedge.operators.finder import DOCUMENT, keyword_documents

# File names of the split layout with separate X and y files, first match wins.
X_FILES = ("X_train.csv", "X_test.csv", "X_val.csv", "X_validation.csv")
Y_FILES = ("y_train.csv", "y_test.csv", "y_val.csv", "y_validation.csv")


def read_header(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8") -> list[str]:
    """Column names of a CSV as written, stripped; repeated names stay repeated."""
    first = spark.read.csv(path, sep=sep, encoding=encoding, header=False, inferSchema=False).first()
    return [] if first is None else [str(c or "").strip() for c in first]


def read_raw(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """CSV with every column as text; numbers are coerced later, so no schema is inferred.

    A missing path raises Spark's ``AnalysisException`` right away.
    """
    names = read_header(spark, path, sep, encoding)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, header=True, enforceSchema=True)
    return raw.toDF(*names)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One table, one folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    """Rows of one split; only its folder is read. ``validation`` may be stored as ``val``."""
    names = [name, "val"] if name == "validation" else [name]
    table = spark.read.parquet(path)
    for stored in names:
        rows = table.where(F.col(split) == stored)
        if not rows.isEmpty():
            return rows.drop(split)
    raise FileNotFoundError(f"no split {name!r} in {path}")


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Keywords of a JSON config ``{"keywords": [...]}``; the defaults when it is missing or names none."""
    read = lambda p: spark.read.schema("keywords array<string>").json(p, multiLine=True)
    try:
        row = _first_existing(spark, [path], read)[0].first()
    except FileNotFoundError:
        row = None
    return list((row and row["keywords"]) or DEFAULT_KEYWORDS)


def _first_existing(spark: SparkSession, paths: Sequence[str], read) -> tuple[DataFrame, str]:
    for path in paths:
        try:
            return read(path), path
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {list(paths)} exists")


def _numbers(df: DataFrame) -> DataFrame:
    """Text columns as doubles, NULL where there is no number."""
    return df.select(*[to_number(F.col(f"`{c}`")).alias(c) for c in df.columns])


def write_split_files(df: DataFrame, features: Sequence[str], target: str, folder: str, name: str) -> dict[str, str]:
    """X and y of a split as CSV, in the layout that ``read_split_files`` reads; returns their paths.

    Both are written from one table, row by row in the same order.
    """
    short = {"Validation": "val", "Val": "val"}.get(name, name.lower())
    written = {}
    for kind, columns in (("X", list(features)), ("y", [target])):
        path = f"{folder.rstrip('/')}/{name}/{kind}_{short}.csv"
        df.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").csv(path, header=True)
        written[f"{kind}_{short}"] = path
    return written


def read_split_files(
    spark: SparkSession,
    folder: str,
    name: str,
    x_files: Sequence[str] = X_FILES,
    y_files: Sequence[str] = Y_FILES,
) -> tuple[DataFrame, DataFrame]:
    """X and y of a split in the layout with one folder per split; ``Validation`` may be ``Val``."""
    names = [name, "Val"] if name == "Validation" else [name]
    read = lambda path: _numbers(spark.read.csv(path, header=True, inferSchema=False))
    at = lambda files: [f"{folder}/{n}/{f}" for n in names for f in files]
    return _first_existing(spark, at(x_files), read)[0], _first_existing(spark, at(y_files), read)[0]


def read_literature(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Papers and long codes. Only an empty cell is NULL: ``None`` and ``NA`` are values as written."""
    papers = spark.read.csv(
        f"{folder}/papers.csv", header=True, nullValue="", multiLine=True, quote='"', escape='"'
    )
    typed = {"paper_id": "long", "year": "int"}
    papers = papers.withColumns({c: F.col(c).try_cast(t) for c, t in typed.items() if c in papers.columns})
    codes = spark.read.csv(
        f"{folder}/codes_long.csv", header=True,
        schema="paper_id long, dimension string, source string, code string",
    )
    return papers, codes


def _flat(df: DataFrame) -> DataFrame:
    """List columns joined by ``; ``, as a CSV cell holds them."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.array_join(F.col(f"`{c}`").cast("array<string>"), "; ") for c in lists})


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> dict[str, str]:
    """One folder per result table; returns their paths."""
    written = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        out = _flat(df) if form == "csv" else df
        settings = {"header": "true", "escape": '"'} if form == "csv" else {}
        out.write.mode("overwrite").options(**settings).format(form).save(path)
        written[name] = path
    return written


def write_snapshot(docs: DataFrame, path: str, keywords: Sequence[str]) -> None:
    """Documents as parquet beside a one-row table of when and for which keywords they were taken."""
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    docs.write.mode("overwrite").parquet(f"{path}/items")
    about = docs.sparkSession.createDataFrame([(stamp, list(keywords))], "generated string, keywords array<string>")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def read_snapshot(spark: SparkSession, paths: Sequence[str], source: str = "cache") -> DataFrame:
    """Documents of the first snapshot that exists: a folder of ours, or a single JSON file.

    A single file wraps its documents in ``items``; one task reads it.
    """

    def read(path: str) -> DataFrame:
        if path.endswith(".json"):
            wrapped = spark.read.schema(f"items array<struct<{DOCUMENT}>>").json(path, multiLine=True)
            return wrapped.select(F.inline("items"))
        return spark.read.parquet(f"{path}/items")

    return _first_existing(spark, paths, read)[0].withColumn("source", F.lit(source))


def search_snapshot(spark: SparkSession, paths: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Snapshot documents that match any keyword."""
    return keyword_documents(read_snapshot(spark, paths), keywords)
