"""Grants and policies: raw records -> one document shape, and keyword search over it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.lexicon import (
    DEFAULT_KEYWORDS,
    GRANT_PORTAL,
    GRANT_STATUSES,
    GRANT_TYPES,
    POLICY_PORTAL,
    POLICY_TYPES,
)
from sedge.functions.text import contains_any, matches_keywords, normal_keyword, without_markup
from sedge.operators.ordering import first_rows

SMALLEST_BUDGET = 1000

GRANT_RECORD = (
    "reference string, url string, title string, summary string, content string, "
    "metadata map<string,string>"
)
POLICY_RECORD = ", ".join(f"{v} struct<value:string>" for v in ("work", "title", "date", "type", "celex"))
DOCUMENT = (
    "id string, kind string, title string, summary string, date string, url string, "
    "budgetEUR long, doctype string, source string"
)
DOCUMENT_COLUMNS = [part.split()[0] for part in DOCUMENT.split(", ")]

# Fixed value: budget fields inside the overview JSON.
OVERVIEW_BUDGET = r'"(?:budget|totalBudget|plannedOpeningBudget)"\s*:\s*"?([\d.,\s]+)"?'


def parse_records(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON text rows -> record columns; every metadata field keeps its JSON text."""
    return raw.select("*", F.from_json(column, schema).alias("_r")).select(
        *[c for c in raw.columns if c != column], "_r.*"
    )


def meta_value(metadata: Column, name: str) -> Column:
    """A metadata field: the first element when it is a list, else the value."""
    text = F.try_element_at(metadata, F.lit(name))
    items = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.when(items.isNull(), text).otherwise(F.get(items, F.lit(0)))


def _first_filled(*parts: Column) -> Column:
    """First part that is neither NULL nor empty; empty when there is none."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def budget_eur(metadata: Column) -> Column:
    """Budget in EUR: the first candidate above 1000, rounded half to even, else NULL.

    Candidates are the direct fields, then every budget inside the overview JSON.
    """
    overview = _first_filled(meta_value(metadata, "budgetOverview"), meta_value(metadata, "budgetOverviewJSONItem"))
    inside = F.when(overview.contains("{"), F.regexp_extract_all(overview, F.lit(OVERVIEW_BUDGET), F.lit(1)))
    direct = F.array(meta_value(metadata, "budget"), meta_value(metadata, "cftEstimatedTotalProcedureValue"))
    candidates = F.concat(F.array_compact(direct), F.coalesce(inside, F.array().cast("array<string>")))
    amounts = F.transform(candidates, lambda c: F.regexp_replace(c, r"[^0-9.]", "").try_cast("double"))
    large = F.filter(amounts, lambda a: a > SMALLEST_BUDGET)
    return F.bround(F.get(large, F.lit(0)), 0).try_cast("long")


def normalize_grants(records: DataFrame, source: str = "cache", summary_length: int | None = None) -> DataFrame:
    """Grant records -> documents; summaries are whole unless a length to show is given."""
    m = F.col("metadata")
    meta = lambda name: meta_value(m, name)
    identifier = _first_filled(meta("identifier"), F.col("reference"), F.col("url"))
    title = _first_filled(meta("title"), F.col("title"), identifier)
    summary = without_markup(_first_filled(meta("description"), F.col("summary"), F.col("content")))
    date = _first_filled(meta("startDate"), meta("publicationDateLong"))
    return records.select(
        F.concat(F.lit("g:"), identifier).alias("id"),
        F.lit("grant").alias("kind"),
        without_markup(title).alias("title"),
        (summary if summary_length is None else F.substring(summary, 1, summary_length)).alias("summary"),
        F.nullif(F.substring(date, 1, 10), F.lit("")).alias("date"),
        F.concat(F.lit(GRANT_PORTAL), F.lower(identifier)).alias("url"),
        budget_eur(m).alias("budgetEUR"),
        F.when(meta("type") == "2", "Tender").otherwise("Call topic").alias("doctype"),
        F.lit(source).alias("source"),
        *[c for c in records.columns if c.startswith("_")],
    )


def normalize_policies(records: DataFrame, source: str = "cache") -> DataFrame:
    """Policy query bindings -> documents."""
    value = lambda name: F.col(f"{name}.value")
    uri = F.coalesce(value("work"), F.lit(""))
    celex = F.nullif(value("celex"), F.lit(""))
    kind = F.substring_index(F.coalesce(value("type"), F.lit("")), "/", -1)
    return records.select(
        F.concat(F.lit("p:"), F.coalesce(celex, uri)).alias("id"),
        F.lit("policy").alias("kind"),
        without_markup(_first_filled(value("title"), uri)).alias("title"),
        F.lit("").alias("summary"),
        F.nullif(F.substring(F.coalesce(value("date"), F.lit("")), 1, 10), F.lit("")).alias("date"),
        F.coalesce(F.concat(F.lit(POLICY_PORTAL), celex), uri).alias("url"),
        F.lit(None).cast("long").alias("budgetEUR"),
        F.coalesce(F.nullif(kind, F.lit("")), F.lit("Act")).alias("doctype"),
        F.lit(source).alias("source"),
        *[c for c in records.columns if c.startswith("_")],
    )


def first_documents(docs: DataFrame, order: Sequence[str]) -> DataFrame:
    """One document per id, the first in the given order."""
    return first_rows(docs, ["id"], order)


def search_grants(
    records: DataFrame,
    order: Sequence[str],
    keywords: Iterable[str] = DEFAULT_KEYWORDS,
    types: Sequence[str] = GRANT_TYPES,
    statuses: Sequence[str] = GRANT_STATUSES,
    limit: int | None = None,
    summary_length: int | None = None,
) -> DataFrame:
    """Grants of the given types and statuses that contain any keyword, one per id, latest status first.

    ``order`` names columns starting with ``_`` that fix which duplicate is the first. Keywords are looked for
    in the whole summary; ``summary_length`` only shortens what is shown.
    """
    meta = lambda name: meta_value(F.col("metadata"), name)
    open_calls = records.where(meta("type").isin(*types) & meta("status").isin(*statuses))
    docs = normalize_grants(open_calls.withColumn("_status", meta("status")))
    hits = docs.where(matches_keywords("title", "summary", list(keywords)))
    if summary_length is not None:
        hits = hits.withColumn("summary", F.substring("summary", 1, summary_length))
    ranked = first_documents(hits, order).orderBy(F.desc("_status"), "id")
    return (ranked if limit is None else ranked.limit(limit)).select(*DOCUMENT_COLUMNS)


def search_policies(
    docs: DataFrame,
    keywords: Iterable[str] = DEFAULT_KEYWORDS,
    since: str = "2015-01-01",
    limit: int | None = None,
    types: Sequence[str] = POLICY_TYPES,
    order: Sequence[str] = ("title", "date", "url"),
) -> DataFrame:
    """Acts of the given types from ``since`` on whose title contains any keyword, one per id, newest first.

    ``order`` fixes which of several hits with the same id is the first.
    """
    clean = [k.replace('"', "").replace("\\", "").lower() for k in keywords]
    title_hit = contains_any(F.lower(F.col("title")), clean)
    hits = docs.where(F.col("doctype").isin(*types) & (F.col("date") >= since) & title_hit)
    ranked = first_documents(hits, order).orderBy(F.desc("date"), "id")
    return (ranked if limit is None else ranked.limit(limit)).select(*DOCUMENT_COLUMNS)


def keyword_documents(docs: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """Documents whose title or summary contains any keyword."""
    return docs.where(matches_keywords("title", "summary", list(keywords)))


def keyword_table(raw: DataFrame, column: str) -> DataFrame:
    """Distinct normalised keywords of a column."""
    return raw.select(normal_keyword(column).alias("keyword")).where("keyword is not null").distinct()


def selected_documents(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Documents whose id is in ``picked``."""
    return docs.join(picked.select("id"), "id", "left_semi")


def all_documents(policies: DataFrame, grants: DataFrame) -> DataFrame:
    return policies.unionByName(grants)
