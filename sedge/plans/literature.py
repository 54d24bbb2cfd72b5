"""Corpus queries: codes from part names, papers from orders and parts, coded rows from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.functions.text import paper_text, slug
from sedge.operators import corpus, hotspots
from sedge.operators.coder import derive_targets
from sedge.plans.registry import Registry, table

registry = Registry()

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
STATUSES = ["F", "O", "P"]


def wide_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codebook cells with repeats, blanks, case and both sources."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("paper_id"),
        F.replace("p_name", F.lit(" "), F.lit("; ")).alias("barriers_title_kw"),
        F.concat(F.upper(F.substring_index("p_name", " ", 1)), F.lit(" ;; "), "p_type").alias("barriers_abstract"),
        F.concat("p_brand", F.lit(";")).alias("drivers_title_kw"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("stakeholders_abstract"),
    )


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tidy_codes(wide_codes(spark, sf))


CODES = r"""
cells AS (
  SELECT p_partkey AS paper_id, 'barriers' AS dimension, 'title_kw' AS source, replace(p_name, ' ', '; ') AS cell FROM part
  UNION ALL SELECT p_partkey, 'barriers', 'abstract', upper(split_part(p_name, ' ', 1)) || ' ;; ' || p_type FROM part
  UNION ALL SELECT p_partkey, 'drivers', 'title_kw', p_brand || ';' FROM part
  UNION ALL SELECT p_partkey, 'stakeholders', 'abstract', CASE WHEN p_size % 2 = 0 THEN p_type END FROM part),
codes AS (
  SELECT * FROM (SELECT paper_id, dimension, source, lower(trim(unnest(string_split(cell, ';')))) AS code FROM cells)
  WHERE code <> '')
"""


@registry.query(f"WITH {CODES} SELECT paper_id, dimension, source, code FROM codes")
def tidy_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes(spark, sf)


@registry.query(
    f"""WITH {CODES}, n AS (SELECT dimension, code, count(DISTINCT paper_id) AS papers FROM codes GROUP BY ALL)
SELECT dimension, code, papers FROM n
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY papers DESC, code) <= 5"""
)
def code_frequency_topn(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.code_frequencies(codes(spark, sf), top=5)


@registry.query(
    f"""WITH {CODES} SELECT dimension, code, count(DISTINCT paper_id) AS papers
FROM codes WHERE dimension = 'barriers' GROUP BY ALL"""
)
def code_frequency_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.code_frequencies(codes(spark, sf), dimension="barriers")


def tagged_papers(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("p_size") != 13, F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), tag.alias("sector_tag"))


@registry.query(
    f"""WITH {CODES},
papers AS (SELECT p_partkey AS paper_id, p_type AS sector FROM part WHERE p_size <> 13),
a AS (SELECT DISTINCT paper_id, code FROM codes WHERE dimension = 'barriers')
SELECT code, {", ".join(f"count(*) FILTER (sector = '{t}') AS {t}" for t in TYPES)}, count(*) AS total
FROM a JOIN papers USING (paper_id) GROUP BY code ORDER BY total DESC, code LIMIT 15"""
)
def code_by_sector(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.code_by_sector(codes(spark, sf), tagged_papers(spark, sf), "barriers", 15, TYPES)


def order_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes per order: part brands as barriers, parts as drivers."""
    lines = table(spark, sf, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("paper_id"), "l_partkey")
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    cells = F.array(
        F.struct(F.lit("barriers").alias("dimension"), F.col("p_brand").alias("code")),
        F.struct(F.lit("drivers").alias("dimension"), F.concat(F.lit("p"), "l_partkey").alias("code")),
    )
    return lines.join(brands, "l_partkey").select("paper_id", F.inline(cells)).withColumn("source", F.lit("abstract"))


COOCCURRENCE = """
codes AS (
  SELECT DISTINCT l_orderkey AS paper_id, 'barriers' AS dimension, p_brand AS code FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT DISTINCT l_orderkey, 'drivers', 'p' || l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey),
kept AS (SELECT dimension, code FROM codes GROUP BY ALL HAVING count(*) >= 30),
frequent AS (SELECT * FROM codes SEMI JOIN kept USING (dimension, code)),
pairs AS (
  SELECT a.code AS code_a, b.code AS code_b, count(*) AS papers
  FROM frequent a JOIN frequent b USING (paper_id)
  WHERE a.dimension = 'barriers' AND b.dimension = 'drivers' GROUP BY ALL)
"""


@registry.query(f"WITH {COOCCURRENCE} SELECT * FROM pairs")
def code_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.code_cooccurrence(order_codes(spark, sf), "barriers", "drivers", min_count=30)


MATRIX = ["Brand#1", "Brand#11", "Brand#25"]


@registry.query(
    f"""WITH {COOCCURRENCE}
SELECT code_b AS code_a, {", ".join(f"coalesce(sum(papers) FILTER (code_a = '{b}'), 0)::BIGINT AS \"{b}\"" for b in MATRIX)}
FROM pairs GROUP BY code_b"""
)
def cooccurrence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    pairs = hotspots.code_cooccurrence(order_codes(spark, sf), "drivers", "barriers", min_count=30)
    return hotspots.cooccurrence_matrix(pairs, MATRIX)


def order_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as papers, with multi-valued place cells."""
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    customers = table(spark, sf, "customer").join(
        nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name"), "c_nationkey"
    )
    orders = table(spark, sf, "orders").join(
        customers.select(F.col("c_custkey").alias("o_custkey"), "n_name", "r_name"), "o_custkey"
    )
    levels = {
        "1-URGENT": "Nazionale, NUTS 2",
        "2-HIGH": "nuts3",
        "3-MEDIUM": " national ,NUTS2, ",
        "5-LOW": "Provincia, Regionale,regional",
    }
    level = F.lit(None).cast("string")
    for priority, cell in levels.items():
        level = F.when(F.col("o_orderpriority") == priority, cell).otherwise(level)
    return orders.select(
        F.col("o_orderkey").alias("paper_id"),
        F.col("o_orderstatus").alias("sector_tag"),
        F.concat("n_name", F.lit(", "), "r_name", F.lit(",, "), "n_name").alias("countries_mentioned"),
        level.alias("geographic_level"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.concat(F.lit(" "), "o_orderpriority")).alias("relevance"),
        F.when(F.col("o_orderkey") % 10 != 0, F.year("o_orderdate")).alias("year"),
    )


@registry.query(
    """WITH p AS (
  SELECT o_orderkey, unnest([n_name, r_name]) AS country
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)
SELECT country, count(DISTINCT o_orderkey) AS papers FROM p GROUP BY country"""
)
def country_counts(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.country_counts(order_papers(spark, sf))


@registry.query(
    """WITH p AS (
  SELECT o_orderkey, unnest(CASE o_orderpriority
    WHEN '1-URGENT' THEN ['National', 'NUTS 2'] WHEN '2-HIGH' THEN ['NUTS 3']
    WHEN '3-MEDIUM' THEN ['National', 'NUTS 2'] WHEN '5-LOW' THEN ['Provincia', 'Regional']
    ELSE ['(unspecified)'] END) AS geo_level FROM orders)
SELECT geo_level, count(*) AS papers FROM p GROUP BY geo_level"""
)
def geo_levels(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.geo_level_counts(order_papers(spark, sf))


STATUS_COUNTS = ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in STATUSES)


@registry.query(
    f"""SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '(none)' ELSE o_orderpriority END AS relevance,
{STATUS_COUNTS} FROM orders GROUP BY ALL"""
)
def crosstab_status(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.crosstab_by_sector(order_papers(spark, sf), "relevance", STATUSES)


@registry.query(
    f"SELECT year(o_orderdate)::INTEGER AS year, {STATUS_COUNTS} FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1"
)
def year_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.year_by_sector(order_papers(spark, sf), STATUSES)


@registry.query(
    f"""WITH {CODES}
SELECT 'papers' AS metric, count(*) AS value FROM part
UNION ALL SELECT 'codes', count(*) FROM codes
UNION ALL SELECT 'sector:' || p_type, count(*) FROM part WHERE p_size <> 13 GROUP BY p_type"""
)
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.corpus_summary(tagged_papers(spark, sf), codes(spark, sf))


@registry.query(
    f"""WITH {CODES},
a AS (SELECT DISTINCT paper_id, dimension || ':' || code AS task FROM codes WHERE dimension IN ('barriers', 'stakeholders')),
t AS (SELECT task FROM a GROUP BY task HAVING count(*) >= 15)
SELECT p.p_partkey AS paper_id, t.task, CASE WHEN a.task IS NULL THEN 'no' ELSE 'yes' END AS label
FROM part p CROSS JOIN t LEFT JOIN a ON a.paper_id = p.p_partkey AND a.task = t.task"""
)
def code_targets(spark: SparkSession, sf: str) -> DataFrame:
    papers = tagged_papers(spark, sf)
    return hotspots.code_targets(codes(spark, sf), papers, ("barriers", "stakeholders"), 15)


def title_papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))


def coded_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One coded row per line item: titles in other case and punctuation, some unknown, some blank."""
    shouted = F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit("--"))), F.lit("! "))
    title = (
        F.when(F.col("l_linenumber") == 7, "  ")
        .when(F.col("p_size") > 45, F.concat(shouted, F.lit("draft")))
        .otherwise(shouted)
    )
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    return table(spark, sf, "lineitem").join(parts, "l_partkey").select(
        title.alias("title"), *ROW_ORDER, F.col("l_suppkey").alias("paper_id")
    )


ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
KEY = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')))"
ALIGN = f"""
papers AS (SELECT {KEY.format("p_name")} AS key, min(p_partkey) AS paper_id, count(*) AS n FROM part GROUP BY 1),
coded AS (
  SELECT CASE WHEN l_linenumber = 7 THEN '  '
              WHEN p_size > 45 THEN '  ' || upper(replace(p_name, ' ', '--')) || '! draft'
              ELSE '  ' || upper(replace(p_name, ' ', '--')) || '! ' END AS title,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey
  FROM lineitem JOIN part ON p_partkey = l_partkey),
keyed AS (SELECT *, {KEY.format("title")} AS key FROM coded)
"""


@registry.query(
    f"""WITH {ALIGN}, firsts AS (
  SELECT * FROM keyed WHERE key <> ''
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1)
SELECT paper_id, title, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM firsts JOIN papers USING (key)"""
)
def title_align(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.align_codebook(title_papers(spark, sf), coded_lines(spark, sf), ROW_ORDER)


@registry.query(
    """WITH keyed AS (SELECT min(p_partkey) AS first_paper, p_name AS title, count(*) AS papers FROM part GROUP BY p_name)
SELECT title, papers, first_paper FROM keyed WHERE papers > 1"""
)
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    papers = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    return corpus.duplicate_titles(papers)


@registry.query(
    f"""WITH {ALIGN}, marked AS (
  SELECT keyed.*, papers.key IS NOT NULL AND keyed.key <> '' AS hit FROM keyed LEFT JOIN papers USING (key))
SELECT count(*) AS coded_rows,
       count(DISTINCT key) FILTER (hit) AS matched,
       count(*) FILTER (NOT hit AND trim(title) <> '') AS unmatched_count,
       count(*) FILTER (hit) - count(DISTINCT key) FILTER (hit) AS duplicate_coded_rows_dropped,
       (SELECT sum(n - 1)::BIGINT FROM papers) AS duplicate_paper_titles
FROM marked"""
)
def title_align_report(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.alignment_report(title_papers(spark, sf), coded_lines(spark, sf))


@registry.query(
    f"""WITH {ALIGN} SELECT l_suppkey AS paper_id, title, l_orderkey, l_linenumber, l_partkey, l_extendedprice
FROM keyed ANTI JOIN papers USING (key) WHERE trim(title) <> ''"""
)
def title_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unaligned_rows(title_papers(spark, sf), coded_lines(spark, sf))


def order_codebook(spark: SparkSession, sf: str) -> DataFrame:
    """One coded row for the orders that have line items, titled by status, sometimes with another title."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        F.count("*").alias("n_lines"), F.max("l_returnflag").alias("sector_tag")
    )
    title = F.when(F.col("n_lines") > 6, F.lit("Other!")).otherwise(F.concat(F.lit("Order - "), "paper_id"))
    return lines.select("paper_id", title.alias("title"), "n_lines", "sector_tag")


def titled_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("paper_id"),
        F.concat(F.lit("order "), "o_orderkey").alias("title"),
        F.col("o_orderstatus").alias("sector_tag"),
    )


@registry.query(
    """WITH c AS (SELECT l_orderkey, count(*) AS n_lines, max(l_returnflag) AS tag FROM lineitem GROUP BY 1)
SELECT o_orderkey AS paper_id, 'order ' || o_orderkey AS title, o_orderstatus AS sector_tag, n_lines, tag AS sector_tag_coded
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey"""
)
def papers_codes_join(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.join_papers_codes(titled_orders(spark, sf), order_codebook(spark, sf))


@registry.query(
    """WITH c AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS joined, count(*) FILTER (n_lines > 6) AS title_mismatches,
       (SELECT count(*) FROM orders) AS papers, (SELECT count(*) FROM c) AS coded
FROM orders JOIN c ON l_orderkey = o_orderkey"""
)
def papers_codes_report(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.join_report(titled_orders(spark, sf), order_codebook(spark, sf))


def raw_paper_list(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under the headers of a landed paper list, with blank titles, bad years and an empty column."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("row"),
        F.when(key % 11 != 0, F.concat("o_orderpriority", F.lit(" "), key)).otherwise("  ").alias("Titolo articolo"),
        F.when(key % 13 == 0, "bad").otherwise(F.year("o_orderdate").cast("string")).alias("Anno di pubblicazione"),
        F.col("o_orderstatus").alias(" TIPO "),
        F.lit("Alta").alias("Rilevanza per il progetto (Alta/Media/Bassa)"),
        F.concat(F.lit("c"), "o_custkey").alias("Extra Col #1"),
        F.lit("  ").alias("Vuota"),
    )


@registry.query(
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS paper_id, o_orderkey AS "row",
  o_orderpriority || ' ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE year(o_orderdate)::INTEGER END AS year,
  o_orderstatus AS sector_tag, 'Alta' AS relevance, 'c' || o_custkey AS extra_col_1
FROM orders WHERE o_orderkey % 11 <> 0"""
)
def paper_list(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tidy_papers(raw_paper_list(spark, sf), ["row"])


@registry.query(
    """SELECT p_partkey AS "row", p_partkey AS paper_id, p_name AS title, p_brand AS ce_title_kw,
  p_type AS barriers_title_kw, 'x' || p_size AS ce_abstract, p_brand || '; ' || p_type AS barriers_abstract,
  'it' AS specific_region, p_type AS sector_tag
FROM part WHERE p_partkey % 5 <> 0"""
)
def codebook(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        key.alias("row"),
        F.when(key % 5 != 0, key.cast("string")).otherwise("n/a").alias("paper_id"),
        F.col("p_name").alias("t"),
        F.col("p_brand").alias("a"),
        F.col("p_type").alias("b"),
        F.concat(F.lit("x"), "p_size").alias("c"),
        F.concat("p_brand", F.lit("; "), "p_type").alias("d"),
        F.lit("it").alias("e"),
        F.lit("").alias("f"),
        F.col("p_type").alias("g"),
    )
    headers = ["row", "paper_id", "Titolo articolo", "CE", "BARRIERS", "CE", "BARRIERS", "SPECIFIC REGION?", "OTHER", "TIPO"]
    return corpus.tidy_codebook(raw.toDF(*headers), ["row"])


@registry.query(
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_brand || ' (' || p_name || ')!'), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'unnamed') AS slug
FROM part"""
)
def slug_values(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")!"))
    return table(spark, sf, "part").select("p_partkey", slug(raw).alias("slug"))


@registry.query(
    """SELECT doc_id, md5(trim(coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, '') || '. ' ||
  coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, ''), chr(9) || chr(10) || chr(13) || ' ')) AS text_md5 FROM documents"""
)
def model_text(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    abstract = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(paper_text(title, abstract)).alias("text_md5"))


@registry.query(
    """WITH p AS (
  SELECT p_partkey AS paper_id,
    CASE p_type WHEN 'ECONOMY' THEN 'AGRI_EU' WHEN 'LARGE' THEN 'mining_out' WHEN 'MEDIUM' THEN ' MIN_EU ' WHEN 'PROMO' THEN 'AGRI_OUT' WHEN 'SMALL' THEN 'X' END AS tag,
    CASE p_size % 6 WHEN 0 THEN 'Alta' WHEN 1 THEN ' molto alta' WHEN 2 THEN 'Media' WHEN 3 THEN 'BASSA' WHEN 4 THEN 'Media/Alta' ELSE '' END AS rel
  FROM part), u AS (SELECT paper_id, upper(trim(coalesce(tag, ''))) AS tag, lower(trim(rel)) AS rel FROM p)
SELECT paper_id, 'sector' AS task, CASE WHEN tag LIKE 'MIN%' THEN 'mining' WHEN tag LIKE 'AGRI%' THEN 'agri' END AS label FROM u
UNION ALL SELECT paper_id, 'region', CASE WHEN tag LIKE '%\\_OUT' ESCAPE '\\' THEN 'out' WHEN tag LIKE '%\\_EU' ESCAPE '\\' THEN 'eu' END FROM u
UNION ALL SELECT paper_id, 'relevance', CASE WHEN rel IN ('alta', 'molto alta', 'media/alta') THEN 'high' WHEN rel IN ('media', 'bassa') THEN 'medium_low' END FROM u"""
)
def paper_targets(spark: SparkSession, sf: str) -> DataFrame:
    tags = {"ECONOMY": "AGRI_EU", "LARGE": "mining_out", "MEDIUM": " MIN_EU ", "PROMO": "AGRI_OUT", "SMALL": "X"}
    tag = F.lit(None).cast("string")
    for kind, value in tags.items():
        tag = F.when(F.col("p_type") == kind, value).otherwise(tag)
    labels = F.array(*[F.lit(x) for x in ("Alta", " molto alta", "Media", "BASSA", "Media/Alta", "")])
    relevance = F.get(labels, F.col("p_size") % 6)
    papers = table(spark, sf, "part").select(
        F.col("p_partkey").alias("paper_id"), tag.alias("sector_tag"), relevance.alias("relevance")
    )
    return derive_targets(papers)
