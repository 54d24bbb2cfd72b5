"""Source, sink and provenance queries: the tables are written, read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.functions.columns import resolve_roles, scenario_variables
from sedge.operators.cleaning import numeric_columns
from sedge.operators.splitting import hash_split
from sedge.plans import documents as finder_plans
from sedge.plans.literature import codes
from sedge.plans.registry import Registry, table
from sedge.plans.sensor import split_sql
from sedge.session import scratch_path
from sedge.sources import provenance, tables

registry = Registry()


@registry.query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus AS status FROM orders"""
)
def raw_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    price = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" key "),
        F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(price).alias(" price"),
        F.col("o_orderstatus").alias("status "),
    )
    raw.write.csv(path, header=True, sep=";", encoding="utf-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = numeric_columns(tables.read_raw(spark, path), ["price"])
    return back.select(F.col("key").cast("long").alias("o_orderkey"), "price", "status")


@registry.query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {split_sql('o_orderkey')} = 'validation'")
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    tables.write_splits(hash_split(rows, ["o_orderkey"]), path)
    return tables.read_split(spark, path, "validation")


@registry.query(
    """SELECT 'codes' AS name, count(*) AS n, NULL::BIGINT AS none FROM (
  SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type FROM part
  UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part WHERE p_size % 2 = 0)
UNION ALL SELECT 'papers', count(*), count(*) FILTER (p_size = 13) FROM part"""
)
def literature_files(spark: SparkSession, sf: str) -> DataFrame:
    """Papers and codes written and read back; the country ``None`` stays a value, an empty one is NULL."""
    folder = scratch_path(spark, "literature")
    country = F.when(F.col("p_size") == 13, F.lit(None).cast("string")).otherwise(F.lit("None"))
    papers = table(spark, sf, "part").select(
        F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), country.alias("countries_mentioned")
    )
    tables.write_tables({"papers.csv": papers, "codes_long.csv": codes(spark, sf)}, folder)
    papers_back, codes_back = tables.read_literature(spark, folder)
    count = F.count("*").alias("n")
    return codes_back.agg(F.lit("codes").alias("name"), count, F.lit(None).cast("long").alias("none")).unionByName(
        papers_back.agg(F.lit("papers").alias("name"), count, F.count_if(F.col("countries_mentioned").isNull()).alias("none"))
    )


@registry.query(
    f"WITH {finder_plans.DOCS} SELECT id, kind, 'cache' AS source FROM docs WHERE {finder_plans.KEYWORD_HIT}"
)
def snapshot_search(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    tables.write_snapshot(finder_plans.documents(spark, sf), path, finder_plans.KEYWORDS)
    return tables.search_snapshot(spark, [path + "-missing", path], finder_plans.KEYWORDS).select("id", "kind", "source")


@registry.query()
def file_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.fingerprints(spark, sf, "*.parquet").drop("path")


TABLE_FILES = ", ".join(
    f"('{t}.parquet')"
    for t in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "gone",
    )
)


@registry.query(
    f"""SELECT key, key <> 'gone.parquet' AS found, key NOT IN ('gone.parquet', 'orders.parquet') AS ok
FROM (VALUES {TABLE_FILES}) AS t(key)"""
)
def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """The table files against a manifest with right, wrong, absent and unknown checksums and a missing file.

    A table may be one file or a folder of part files: it is found, and right, when all its files are.
    """
    files = provenance.fingerprints(spark, sf, "*.parquet")
    of = F.substring_index("key", "/", 1)
    checksum = (
        F.when(of == "orders.parquet", F.concat(F.lit("md5:"), F.lpad(F.lit("0"), 32, "0")))
        .when(of == "part.parquet", "")
        .when(of == "nation.parquet", "sha256:abc")
        .otherwise(F.concat(F.lit("md5:"), F.upper("md5")))
    )
    listed = files.select("key", F.col("length").alias("size"), checksum.alias("checksum"))
    gone = files.where(of == "region.parquet").select(
        F.lit("gone.parquet").alias("key"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("checksum")
    ).distinct()
    checked = provenance.verify_manifest(listed.unionByName(gone), files)
    return checked.groupBy(of.alias("key")).agg(F.bool_and("found").alias("found"), F.bool_and("ok").alias("ok"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as landed archive records with zero to two files."""
    s = F.col("s_suppkey")
    one = F.concat(F.lit('{"key":"a'), s, F.lit('.csv","size":'), s, F.lit(',"checksum":"md5:ab"}'))
    files = F.when(s % 3 == 0, "").when(s % 3 == 1, one).otherwise(F.concat(one, F.lit(","), one))
    line = F.concat(
        F.lit('{"id":'), s, F.lit(',"doi":"10.1/x.'), s, F.lit('","metadata":{"title":"'), "s_name",
        F.lit('","publication_date":"2026-06-18","resource_type":{"title":"Dataset"}},"files":['), files,
        F.lit('],"links":{"self_html":"https://a.org/'), s, F.lit('"}}'),
    )
    return table(spark, sf, "supplier").select(F.from_json(line, provenance.ARCHIVE_RECORD).alias("r")).select("r.*")


@registry.query(
    """SELECT s_suppkey AS record_id, '10.1/x.' || s_suppkey AS doi, s_name AS title, '2026-06-18' AS publication_date, 'Dataset' AS resource_type,
  (s_suppkey % 3)::INTEGER AS n_files, 'https://a.org/' || s_suppkey AS html FROM supplier"""
)
def record_summaries(spark: SparkSession, sf: str) -> DataFrame:
    flat = provenance.record_summaries(records(spark, sf))
    return flat.withColumn("n_files", F.size("files")).drop("files")


@registry.query(
    """SELECT s_suppkey AS record_id, '10.1/x.' || s_suppkey AS doi, CASE WHEN s_suppkey % 3 > 0 THEN 'a' || s_suppkey || '.csv' END AS key,
  CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS size, CASE WHEN s_suppkey % 3 > 0 THEN 'md5:ab' END AS checksum
FROM supplier, range(greatest(s_suppkey % 3, 1))"""
)
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.record_files(records(spark, sf))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a reference in one of the forms in which records are cited; one in five names none."""
    k = F.col("o_orderkey")
    form = (
        F.when(k % 5 == 0, F.concat(F.lit(" 10.5281/zenodo."), k))
        .when(k % 5 == 1, F.concat(F.lit("https://archive.org/records/"), k, F.lit("?x=1")))
        .when(k % 5 == 2, k.cast("string"))
        .when(k % 5 == 3, F.concat(F.lit("https://archive.org/record/"), k))
        .otherwise(F.concat(F.lit("not-a-doi "), k))
    )
    return table(spark, sf, "orders").select(k, form.alias("reference"))


@registry.query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_orderkey::VARCHAR END AS record FROM orders"""
)
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    return references(spark, sf).select("o_orderkey", provenance.record_id("reference").alias("record"))


@registry.query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no reference' ELSE 'no record number in: not-a-doi ' || o_orderkey END AS reason
FROM orders WHERE o_orderkey % 5 = 4 OR o_orderkey % 7 = 0"""
)
def record_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The same references, every seventh of them blank: the rows that no record can be found for."""
    blank = F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("reference"))
    return provenance.record_rejects(references(spark, sf).withColumn("reference", blank), "reference").select("o_orderkey", "reason")


def sensor_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Line items under the headers of a raw sensor file."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 60).alias("Time (min)"),
        F.col("l_extendedprice").alias("Temperature (°C)"), F.col("l_quantity").alias("RPM"), F.col("l_tax").alias("Pressure (bar)"),
    )


@registry.query(
    """SELECT l_orderkey AS "order", l_linenumber AS line, 'Temperature (°C), RPM' AS features, (l_linenumber * 60)::INTEGER AS clock, l_extendedprice AS first_feature,
  l_quantity AS second_feature, l_tax AS target FROM lineitem"""
)
def role_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Feature, target and clock columns of a raw table, asked for by their configured names."""
    raw = sensor_headers(spark, sf)
    features, target, clock = resolve_roles(raw.columns, ["time", "temperature", "stirring"], "pressure")
    at = [F.col(f"`{f}`") for f in features]
    return raw.select(
        "order", "line", F.lit(", ".join(features)).alias("features"), F.col(f"`{clock}`").alias("clock"),
        at[0].alias("first_feature"), at[1].alias("second_feature"), F.col(f"`{target}`").alias("target"),
    )


@registry.query(
    """SELECT 'Time (min)' AS variable, count(*) AS n, min(l_linenumber * 60)::DOUBLE AS low, max(l_linenumber * 60)::DOUBLE AS high FROM lineitem
UNION ALL SELECT 'Temperature (°C)', count(*), min(l_extendedprice), max(l_extendedprice) FROM lineitem
UNION ALL SELECT 'RPM', count(*), min(l_quantity), max(l_quantity) FROM lineitem"""
)
def sweep_variables(spark: SparkSession, sf: str) -> DataFrame:
    """The variables that a sweep finds in a raw table, with their bounds."""
    raw = sensor_headers(spark, sf)
    found = scenario_variables(raw.columns)
    values = raw.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in found]).unpivot([], [f"`{c}`" for c in found], "variable", "value")
    bounds = values.groupBy(F.replace("variable", F.lit("`"), F.lit("")).alias("variable"))
    return bounds.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@registry.query(
    """SELECT k AS keyword, count(*) AS n FROM part, (SELECT DISTINCT split_part(p_name, ' ', 1) AS k FROM part) WHERE contains(lower(p_name), lower(k)) GROUP BY 1"""
)
def keyword_config(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords written as a JSON config (the first words of part names), read back, and the parts that hold each."""
    parts, path = table(spark, sf, "part"), scratch_path(spark, "keywords")
    words = parts.select(F.substring_index("p_name", " ", 1).alias("k")).distinct()
    words.agg(F.array_sort(F.collect_set("k")).alias("keywords")).coalesce(1).write.json(path)
    wanted = F.array(*[F.lit(k) for k in tables.read_keywords(spark, path)])
    held = F.filter(wanted, lambda k: F.contains(F.lower("p_name"), F.lower(k)))
    return parts.select(F.explode(held).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@registry.query(
    f"""WITH rows AS (SELECT * FROM orders WHERE {split_sql('o_orderkey')} = 'validation')
SELECT 'o_custkey' AS name, count(*) AS n, sum(o_custkey)::DOUBLE AS total FROM rows
UNION ALL SELECT 'o_orderkey', count(*), sum(o_orderkey)::DOUBLE FROM rows
UNION ALL SELECT 'o_totalprice', count(*), round(sum(o_totalprice), 2)::DOUBLE FROM rows"""
)
def legacy_split_files(spark: SparkSession, sf: str) -> DataFrame:
    """A validation split as X and y files in a folder of the older name, found under the newer one."""
    folder = scratch_path(spark, "legacy")
    rows = hash_split(table(spark, sf, "orders"), ["o_orderkey"]).where("split = 'validation'")
    tables.write_split_files(rows, ["o_orderkey", "o_custkey"], "o_totalprice", folder, "Val")
    x, y = tables.read_split_files(spark, folder, "Validation")
    total = lambda df, c: df.agg(F.lit(c).alias("name"), F.count("*").alias("n"), F.round(F.sum(c), 2).alias("total"))
    return total(x, "o_custkey").unionByName(total(x, "o_orderkey")).unionByName(total(y, "o_totalprice"))
