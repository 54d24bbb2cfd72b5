"""Queries over the given tables for the operators of this package, with comparison SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import (
    contamination, digest_merge, jump, near, packing, periods, pseudo, quality, resampling, separators, token_store, toxicity, urls,
)
from sedge.llm.scratch import scratch_path
from sedge.llm.tokens import vocabulary_path
from sedge.plans.registry import Registry, table

registry = Registry()

SEQUENCE = 2048
SHARDS = 24
# The rules that the pages are held against.
PAGE_RULES = (
    urls.listed("allow", "org", "/"),
    urls.listed("block", "example.org", "/es/"),
    urls.listed("block", "example.org", "/en/1"),
    urls.listed("allow", "com", "/fr/"),
    urls.listed("block", "com", "/de/"),
)


def fold(key: str, folds: int) -> Column:
    """Remainder of the checksum of a key's digits; null keys have none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


@registry.query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat token files."""
    documents = table(spark, sf_dir, "documents")
    return separators.document_tokens(documents, "doc_id", "text", vocabulary_path(), scratch_path(spark, "token-files"))


@registry.query()
def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a network trained on all of them."""
    documents = table(spark, sf_dir, "documents")
    words = pseudo.word_counts(documents, "text")
    return pseudo.score_texts(documents, "doc_id", "text", pseudo.fit_pseudo_likelihood(documents, "text", words=words), words)


@registry.query()
def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; rows of remainder 1 lend no label."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = labels.filter((F.col("quality") == 1) & (fold("doc_id", 3) != 1))
    model = quality.fit_quality(documents, trusted, "doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return quality.score_quality(documents, "doc_id", "text", model, held_out)


@registry.query(
    r"""
    WITH cut AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?:[^:]|:[^/]|:/[^/])*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '^(?:[^:]|:[^/]|:/[^/])*?://[^/?#]*([^?#]*)', 1, 's') AS path
        FROM pages),
    rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    fits AS (
        SELECT c.host, c.path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
        FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules
          ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)
        GROUP BY 1, 2)
    SELECT page_id, c.host, c.path, f.rule,
           coalesce(f.v, CASE WHEN regexp_matches(c.host, '(^|[.-])(adult|casino|porn|viagra|warez|xxx)([.-]|$)')
                              THEN 'block' ELSE 'allow' END) AS verdict
    FROM cut c LEFT JOIN fits f ON c.host = f.host AND c.path = f.path
    """
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the listed rules and the method's own."""
    rules = [*PAGE_RULES, *map(urls.unwanted, urls.UNWANTED)]
    return urls.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", rules)


@registry.query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path(), SEQUENCE)


@registry.query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; rows of remainder 2 lend no label."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(fold("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit_toxicity(documents, known, "doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score_toxicity(documents, "doc_id", "text", model, held_out)


@registry.query(
    r"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    sets AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM worded),
    sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM sets),
    members AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (
        SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
    ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM sizes
        UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
    SELECT sizes.doc_id, n::BIGINT AS n_shingles, min(other) AS component_id FROM sizes JOIN reach ON reach.doc_id = sizes.doc_id GROUP BY ALL
    """
)
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@registry.query()
def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards, and where 25 would put them."""
    return jump.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


@registry.query(
    """
    WITH t AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return digest_merge.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@registry.query()
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item, with the item and the place."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination.contaminated(documents, "doc_id", "text", benchmark, "item_id", "text")
    return found.withColumnRenamed("item", "item_id")


@registry.query()
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the test items, and the twentieth of them that is drawn."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = resampling.resample(documents, "doc_id", "text", benchmark, "text")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@registry.query()
def op12_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as coded token files, read back."""
    path = scratch_path(spark, "coded-tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path(), path, end_id=2)
    read = token_store.read_tokens(spark, path)
    return read.select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def with_repeats(key: str, text: str) -> Column:
    """The text; where the key's checksum ends in 0, its words from a place on repeat a stretch from there."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeat = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))
        return F.array_join(F.transform(words, repeat), " ")

    # Behind a lambda, the words are split once and not once per word.
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(F.col(text))


@registry.query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which have repeats put in, and the digest of the text without them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", with_repeats("doc_id", "text").alias("text"))
    found = periods.periodic_runs(documents, "doc_id", "text")
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
