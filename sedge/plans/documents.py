"""Finder queries: documents as policies and grants, pages and events as raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.functions.lexicon import TERM_STOPWORDS
from sedge.functions.text import has_term, without_markup
from sedge.operators import finder, terms
from sedge.operators.ordering import first_rows
from sedge.plans.registry import Registry, table
from sedge.session import scratch_path

registry = Registry()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by their first line and whole text; the source's number decides the kind."""
    even = F.substring("source", 4, 9).cast("int") % 2 == 0
    return table(spark, sf, "documents", "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(even, "policy").otherwise("grant").alias("kind"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        F.lower("lang").alias("lang"),
        "source",
    )


DOCS = """
docs AS (
  SELECT doc_id::VARCHAR AS id, CASE WHEN substr(source, 4)::INTEGER % 2 = 0 THEN 'policy' ELSE 'grant' END AS kind,
         split_part(text, chr(10), 1) AS title, text AS summary, lang, source FROM documents)
"""
STOP = "[" + ", ".join(f"'{w}'" for w in TERM_STOPWORDS) + "]"
LISTED = f"""{DOCS},
worded AS (
  SELECT id, kind, list_filter(list_transform(string_split(regexp_replace(lower(title || ' ' || summary), '[^a-zà-ÿ0-9-]+', ' ', 'g'), ' '),
    lambda w: trim(w, '-')), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')) AS words FROM docs),
kept AS (SELECT id, kind, list_transform(words, lambda w: CASE WHEN list_contains({STOP}, w) THEN NULL ELSE w END) AS k FROM worded),
listed AS (
  SELECT id, kind, list_distinct(list_filter(k, lambda w: w IS NOT NULL) ||
    list_filter(list_transform(range(1, greatest(len(k), 1)), lambda i: k[i] || ' ' || k[i + 1]), lambda w: w IS NOT NULL)) AS terms
  FROM kept),
floor AS (SELECT CASE WHEN count(*) > 12 THEN 2 ELSE 1 END AS least_df FROM documents)
"""
TERMS = f"""{LISTED},
freq AS MATERIALIZED (SELECT kind, term, count(*) AS df FROM (SELECT kind, unnest(terms) AS term FROM listed) GROUP BY ALL)
"""


@registry.query(
    f"WITH {TERMS} SELECT id, kind, len(terms) AS n_terms, md5(array_to_string(list_sort(terms), '|')) AS terms_md5 FROM listed WHERE len(terms) > 0"
)
def doc_terms(spark: SparkSession, sf: str) -> DataFrame:
    # A filter on the list itself would move below everything that makes it and split the texts again.
    lists = terms.term_lists(documents(spark, sf)).select("id", "kind", F.explode(F.array("terms")).alias("terms"))
    found = lists.where(F.size("terms") > 0)
    listed = F.array_join(F.array_sort("terms"), "|")
    return found.select("id", "kind", F.size("terms").cast("long").alias("n_terms"), F.md5(listed).alias("terms_md5"))


@registry.query(f"WITH {TERMS} SELECT kind, term, df FROM freq")
def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(documents(spark, sf))


@registry.query(
    f"""WITH {TERMS},
common AS (SELECT freq.* FROM freq, floor WHERE df >= least_df),
inside AS (SELECT kind, word, max(df) AS pair FROM (
  SELECT kind, df, unnest(string_split(term, ' ')) AS word FROM common WHERE contains(term, ' ')) GROUP BY ALL),
pruned AS (SELECT c.* FROM common c LEFT JOIN inside i ON i.kind = c.kind AND i.word = c.term WHERE i.pair IS NULL OR i.pair < c.df)
SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY df DESC, term))::INTEGER AS rank, term, df FROM pruned QUALIFY rank <= 15"""
)
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.top_terms(documents(spark, sf))


ASKED = ["  Eronst", "ing", "the", "ine thea", "SOIL"]


@registry.query(
    f"""WITH {LISTED},
sizes AS (
  SELECT count(*) FILTER (even) AS np, count(*) FILTER (NOT even) AS ng FROM (SELECT substr(source, 4)::INTEGER % 2 = 0 AS even FROM documents)),
shared AS MATERIALIZED (
  SELECT term, sum(policy)::BIGINT AS df_policy, (count(*) - sum(policy))::BIGINT AS df_grant
  FROM (SELECT (kind = 'policy')::INTEGER AS policy, unnest(terms) AS term FROM listed) GROUP BY term HAVING max(policy) > min(policy)),
common AS MATERIALIZED (
  SELECT shared.*, least(df_policy / np, df_grant / ng) AS score FROM shared, sizes, floor
  WHERE df_policy >= least_df AND df_grant >= least_df),
inside AS (SELECT word, max(score) AS pair FROM (
  SELECT score, unnest(string_split(term, ' ')) AS word FROM common WHERE contains(term, ' ')) GROUP BY ALL),
top AS MATERIALIZED (
  SELECT c.* FROM common c LEFT JOIN inside i ON i.word = c.term WHERE i.pair IS NULL OR i.pair < c.score
  ORDER BY score DESC, df_policy + df_grant DESC, term LIMIT 14)
SELECT term, df_policy, df_grant, round(score, 9) AS score FROM top
UNION ALL SELECT term, df_policy, df_grant, 0e0 FROM shared
WHERE term IN ('eronst', 'ing', 'the', 'ine thea', 'soil') AND term NOT IN (SELECT term FROM top)"""
)
def bridge_topics(spark: SparkSession, sf: str) -> DataFrame:
    out = terms.bridge_topics(documents(spark, sf), ASKED)
    return out.withColumn("score", F.round("score", 9))


TOPICS = ["ing", "the", "éau", "ent la", "nowhere at all"]
TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
TOPIC_HITS = f"""{DOCS},
hits AS (SELECT topic, id, kind, title FROM docs, (SELECT unnest({TOPIC_LIST}) AS topic) WHERE contains(lower(title || ' ' || summary), topic))
"""


@registry.query(
    f"""WITH {TOPIC_HITS} SELECT t.topic, count(id) FILTER (kind = 'policy') AS policies, count(id) FILTER (kind = 'grant') AS grants
FROM (SELECT unnest({TOPIC_LIST}) AS topic) t LEFT JOIN hits USING (topic) GROUP BY ALL"""
)
def topic_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return terms.topic_bundles(documents(spark, sf), TOPICS)


@registry.query(f"WITH {TOPIC_HITS} SELECT topic, id, kind, title FROM hits")
def topic_documents(spark: SparkSession, sf: str) -> DataFrame:
    return terms.topic_documents(documents(spark, sf), TOPICS).select("topic", "id", "kind", "title")


TFIDF = f"""
worded AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP}, w)) AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM worded),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
kept AS (
  SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2),
raw AS (
  SELECT doc_id, term, tf, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS r FROM counts JOIN kept USING (term)),
weights AS (SELECT doc_id, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""


@registry.query(
    f"""WITH {TFIDF} SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest,
md5(string_agg(term || ':' || tf, '|' ORDER BY term)) AS terms_md5 FROM weights GROUP BY doc_id"""
)
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = terms.tfidf(table(spark, sf, "documents"), "doc_id", "text", stopwords=TERM_STOPWORDS)
    entry = F.concat("term", F.lit(":"), "tf")
    listed = F.array_sort(F.collect_list(F.struct("term", entry.alias("entry"))))
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"),
        F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.max("weight"), 6).alias("largest"),
        F.md5(F.array_join(F.transform(listed, lambda e: e["entry"]), "|")).alias("terms_md5"),
    )


# --- search -----------------------------------------------------------------

KEYWORDS = ["Eronst ", "réent", "soil"]
KEYWORD_HIT = " OR ".join(f"contains(lower(title || ' ' || summary), '{k.lower()}')" for k in KEYWORDS)


@registry.query(f"WITH {DOCS} SELECT id, kind, title FROM docs WHERE {KEYWORD_HIT}")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return finder.keyword_documents(documents(spark, sf), KEYWORDS).select("id", "kind", "title")


WORDS = ["the", "eau", "ing on"]


@registry.query(
    "SELECT doc_id, " + ", ".join(
        f"regexp_matches(lower(text), '(^|[^a-z0-9_]){w}($|[^a-z0-9_])') AS has_{w.replace(' ', '_')}" for w in WORDS
    ) + " FROM documents"
)
def whole_word_match(spark: SparkSession, sf: str) -> DataFrame:
    lowered = table(spark, sf, "documents", "doc_id").select("doc_id", F.lower("text").alias("text"))
    return lowered.select("doc_id", *[has_term("text", w).alias(f"has_{w.replace(' ', '_')}") for w in WORDS])


@registry.query(
    """SELECT DISTINCT keyword FROM (SELECT lower(trim(regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+', ' ', 'g'))) AS keyword
FROM conversations) WHERE length(keyword) >= 2"""
)
def keyword_table(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "conversations").select(F.col("text").alias("raw"))
    return finder.keyword_table(raw, "raw")


@registry.query(
    f"""WITH {DOCS} SELECT id, kind, source FROM docs WHERE kind = 'policy' AND id IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)
UNION ALL SELECT id, kind, source FROM docs WHERE kind = 'grant' AND id IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)"""
)
def selected_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    both = finder.all_documents(docs.where("kind = 'policy'"), docs.where("kind = 'grant'"))
    picked = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return finder.selected_documents(both, picked).select("id", "kind", "source")


# --- raw records ------------------------------------------------------------

CLEAN = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))"


@registry.query(f"SELECT page_id, {CLEAN.format('html')} AS text FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages", "page_id").select("page_id", without_markup("html").alias("text"))


def _field(key: str, value: Column) -> Column:
    """One metadata entry; NULL values are left out later."""
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def budget_records(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as budget metadata: direct, tender, overview, tiny and broken values."""
    k = F.get_json_object("props", "$.k").cast("long")
    amount, kind = (k * 100 + F.col("event_id")).cast("string"), F.col("event_id") % 6
    listed = lambda *parts: F.concat(F.lit('["'), *parts, F.lit('"]'))
    overview = listed(
        F.lit('{\\"a\\": {\\"budget\\" : \\"'), k.cast("string"), F.lit('\\", \\"totalBudget\\": '), amount, F.lit(",500 }}")
    )
    direct = F.when(kind == 0, listed(amount)).when(kind == 1, amount).when(kind == 5, listed(F.lit("n/a")))
    tender = F.when(kind.isin(2, 5), listed(F.lit("EUR "), amount, F.lit(".5")))
    inside = F.when(kind == 3, overview).when(kind == 4, listed(F.lit("budget: "), amount))
    fields = F.array(
        _field("budget", direct),
        _field("cftEstimatedTotalProcedureValue", tender),
        _field("budgetOverviewJSONItem", inside),
    )
    return table(spark, sf, "events").select(
        "event_id", F.map_from_entries(F.filter(fields, lambda f: f["value"].isNotNull())).alias("metadata")
    )


@registry.query(
    """WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT * 100 + event_id AS a, (props->>'$.k')::BIGINT AS k FROM events),
v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN round_even(a + 0.5, 0)::BIGINT
  WHEN 3 THEN a * 1000 + 500 WHEN 5 THEN round_even(a + 0.5, 0)::BIGINT END AS budget,
  CASE event_id % 6 WHEN 2 THEN a + 0.5 WHEN 5 THEN a + 0.5 WHEN 3 THEN a * 1000 + 500 ELSE a END AS plain FROM e)
SELECT event_id, CASE WHEN plain > 1000 THEN budget END AS budget_eur FROM v"""
)
def budget_extract(spark: SparkSession, sf: str) -> DataFrame:
    return budget_records(spark, sf).select("event_id", finder.budget_eur(F.col("metadata")).alias("budget_eur"))


def grant_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as landed grant JSON: missing identifiers, tags in titles, every id landed twice."""
    p = F.col("page_id")
    listed = lambda c: F.to_json(F.array(c))
    meta = F.array(
        _field("identifier", F.when(p % 7 != 0, listed(F.concat(F.lit("HORIZON-"), p)))),
        _field("title", F.when(p % 5 != 0, listed("html"))),
        _field("description", listed("html")),
        _field("startDate", F.when(p % 4 != 0, listed(F.lit("2025-09-15T00:00:00.000+0200")))),
        _field("type", F.when(p % 9 == 0, F.lit('"2"')).otherwise(listed(F.lit("1")))),
        _field("status", listed(F.concat(F.lit("3109450"), p % 5))),
        _field("budget", F.when(p % 3 != 0, listed((p * 1000).cast("string")))),
    )
    present = F.filter(meta, lambda f: f["value"].isNotNull())
    named = F.transform(present, lambda f: F.concat(F.lit('"'), f["key"], F.lit('":'), f["value"]))
    fields = F.array_join(named, ",")
    reference = F.when(p % 14 != 0, F.concat(F.lit('"reference":"ref-'), p, F.lit('",'))).otherwise("")
    line = F.concat(F.lit("{"), reference, F.lit('"url":"http://x/'), p, F.lit('","metadata":{'), fields, F.lit("}}"))
    lines = table(spark, sf, "pages", "page_id").select(p, line.alias("value"))
    copies = lines.select(p, "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    landed = F.concat(F.lit('{"_landed":'), F.col("copy") * 1_000_000_000 + p, F.lit(","), F.substr("value", F.lit(2)))
    path = scratch_path(spark, "landed-grants")
    copies.select(landed).write.text(path)
    return spark.read.schema(f"_landed long, {finder.GRANT_RECORD}").json(path)


GRANTS = f"""
ids AS (SELECT *, CASE WHEN page_id % 7 <> 0 THEN 'HORIZON-' || page_id WHEN page_id % 14 <> 0 THEN 'ref-' || page_id
  ELSE 'http://x/' || page_id END AS ident FROM pages),
grants AS (
  SELECT page_id, 'g:' || ident AS id, 'grant' AS kind,
    CASE WHEN page_id % 5 <> 0 THEN {CLEAN.format('html')} ELSE ident END AS title,
    {CLEAN.format('html')} AS summary, CASE WHEN page_id % 4 <> 0 THEN '2025-09-15' END AS date,
    'https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/' || lower(ident) AS url,
    CASE WHEN page_id % 3 <> 0 AND page_id > 1 THEN page_id * 1000 END AS "budgetEUR",
    CASE WHEN page_id % 9 = 0 THEN 'Tender' ELSE 'Call topic' END AS doctype, 'cache' AS source FROM ids)
"""


@registry.query(f"WITH {GRANTS} SELECT * EXCLUDE (page_id) FROM grants")
def normalize_grants(spark: SparkSession, sf: str) -> DataFrame:
    docs = finder.normalize_grants(grant_records(spark, sf))
    return finder.first_documents(docs, ["_landed"]).select(*finder.DOCUMENT_COLUMNS)


GRANT_KEYWORDS = ["the", "Nicht"]


@registry.query(
    f"""WITH {GRANTS} SELECT * EXCLUDE (page_id) FROM grants WHERE page_id % 9 <> 0 AND page_id % 5 IN (1, 2, 3)
AND (contains(lower(title || ' ' || summary), 'the') OR contains(lower(title || ' ' || summary), 'nicht'))
ORDER BY page_id % 5 DESC, id"""
)
def search_grants(spark: SparkSession, sf: str) -> DataFrame:
    return finder.search_grants(grant_records(spark, sf), ["_landed"], GRANT_KEYWORDS)


POLICY_KINDS = ["REG", "DIR", "DEC", "COM", "OPIN"]


def policy_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as policy bindings; some without legal number, type or title, and every third landed twice under two titles."""
    i = F.col("doc_id")
    copies = F.when(i % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    landed = table(spark, sf, "documents", "doc_id").select("doc_id", "text", F.explode(copies).alias("_landed"))
    title = F.concat(F.when(F.col("_landed") == 1, "<b>The</b> ").otherwise("<p>"), "text")
    boxed = lambda c, n: F.struct(c.cast("string").alias("value")).alias(n)
    kind = F.get(F.array(*[F.lit(k) for k in POLICY_KINDS]), (i % 5).cast("int"))
    date = F.concat((2008 + i % 15).cast("string"), F.lit("-0"), (1 + i % 9).cast("string"), F.lit("-15T00:00:00"))
    return landed.select(
        "_landed",
        boxed(F.concat(F.lit("http://cellar/"), i), "work"),
        boxed(F.when(i % 11 != 0, title), "title"),
        boxed(date, "date"),
        boxed(F.when(i % 13 != 0, F.concat(F.lit("http://types/"), kind)), "type"),
        boxed(F.when(i % 4 != 0, F.concat(F.lit("3"), i)), "celex"),
    )


POLICIES = f"""
policies AS (
  SELECT CASE WHEN doc_id % 4 <> 0 THEN 'p:3' || doc_id ELSE 'p:http://cellar/' || doc_id END AS id, 'policy' AS kind,
    CASE WHEN doc_id % 11 <> 0 THEN {CLEAN.format("((CASE WHEN landed = 1 THEN '<b>The</b> ' ELSE '<p>' END) || text)")} ELSE 'http://cellar/' || doc_id END AS title,
    '' AS summary, (2008 + doc_id % 15) || '-0' || (1 + doc_id % 9) || '-15' AS date,
    CASE WHEN doc_id % 4 <> 0 THEN 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:3' || doc_id ELSE 'http://cellar/' || doc_id END AS url,
    NULL::BIGINT AS "budgetEUR", landed,
    CASE WHEN doc_id % 13 <> 0 THEN ['REG', 'DIR', 'DEC', 'COM', 'OPIN'][doc_id % 5 + 1] ELSE 'Act' END AS doctype, 'cache' AS source
  FROM documents, LATERAL (SELECT unnest(CASE WHEN doc_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS landed))
"""


@registry.query(f"WITH {POLICIES} SELECT * EXCLUDE (landed) FROM policies")
def normalize_policies(spark: SparkSession, sf: str) -> DataFrame:
    return finder.normalize_policies(policy_records(spark, sf)).select(*finder.DOCUMENT_COLUMNS)


@registry.query(
    f"""WITH {POLICIES} SELECT * EXCLUDE (landed) FROM policies WHERE doctype IN ('REG', 'DIR', 'DEC', 'COM') AND date >= '2015-01-01'
AND (contains(lower(title), 'the') OR contains(lower(title), 'eau'))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY landed) = 1"""
)
def search_policies(spark: SparkSession, sf: str) -> DataFrame:
    docs = finder.normalize_policies(policy_records(spark, sf))
    return finder.search_policies(docs, ['th"e', "eau"], order=["_landed"])


@registry.query(
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"
)
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return first_rows(rows, ["user_id"], ["ts", "event_id"]).drop("ts")
