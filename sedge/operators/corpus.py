"""Paper list and codebook: headers, ids, alignment by title, tidy codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.columns import header_slug
from sedge.functions.lexicon import (
    CODE_DIMENSIONS,
    CODEBOOK_HEADERS,
    PAPER_HEADERS,
    RELEVANCE_HEADER,
)
from sedge.functions.numbers import to_number
from sedge.functions.text import split_codes, strip, title_key
from sedge.operators.ordering import first_rows, positions


def paper_headers(headers: Sequence[str]) -> list[str]:
    """Italian headers -> English names; unknown ones become slugs."""

    def name(header: str) -> str:
        if header.startswith(RELEVANCE_HEADER[0]) and header.endswith(RELEVANCE_HEADER[1]):
            return "relevance"
        return PAPER_HEADERS.get(header, header_slug(header))

    return [name(str(h).strip()) for h in headers]


def codebook_headers(headers: Sequence[str]) -> list[str]:
    """Codebook headers by position: a dimension's first column holds title codes, its second abstract codes."""
    out: list[str] = []
    seen: list[str] = []
    for header in (str(h).strip() for h in headers):
        if header in CODE_DIMENSIONS:
            out.append(f"{header.lower()}_{'abstract' if header in seen else 'title_kw'}")
        else:
            out.append(CODEBOOK_HEADERS.get(header, header_slug(header)))
        seen.append(header)
    return out


def _filled_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns without a header or without any non-blank cell; one pass over the table."""
    blank = lambda c: strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) == ""
    used = df.agg(*[F.bool_or(~blank(c)).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if c in keep or (c != "unnamed" and used[c])])


def _named(df: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rename by position, leaving order columns alone; headers left over as ``unnamed`` go.

    A name that repeats keeps its first column.
    """
    final = [o if o in order else n for o, n in zip(df.columns, names)]
    plain = df.toDF(*[f"_{i}" for i in range(len(final))])
    first = {n: i for i, n in reversed(list(enumerate(final)))}
    return plain.select(*[F.col(f"_{i}").alias(n) for n, i in first.items()][::-1])


def tidy_papers(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Paper list with English names, rows without title dropped, dense ``paper_id`` in ``order``, integer year."""
    named = _filled_columns(_named(raw, paper_headers(raw.columns), order), order)
    if "title" in named.columns:
        named = named.where(strip(F.coalesce("title", F.lit(""))) != "")
    out = positions(named, order, "paper_id")
    if "year" in out.columns:
        out = out.withColumn("year", to_number("year").try_cast("int"))
    return out.select("paper_id", *[c for c in out.columns if c != "paper_id"])


def tidy_codebook(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Codebook with its doubled dimension columns told apart; rows without numeric id dropped."""
    named = _filled_columns(_named(raw, codebook_headers(raw.columns), order), order)
    if "paper_id" not in named.columns:
        return named
    ids = named.withColumn("paper_id", to_number("paper_id").try_cast("long"))
    return ids.where(F.col("paper_id").isNotNull())


def _first_papers(papers: DataFrame) -> DataFrame:
    """One row per title key with the lowest paper id."""
    return papers.groupBy(title_key(F.coalesce("title", F.lit(""))).alias("_key")).agg(
        F.min("paper_id").alias("paper_id"), F.count("*").alias("_papers")
    )


def _keyed(coded: DataFrame) -> DataFrame:
    return coded.withColumn("_key", title_key(F.coalesce("title", F.lit(""))))


def align_codebook(papers: DataFrame, coded: DataFrame, order: Sequence[str]) -> DataFrame:
    """Coded rows with the paper id their title belongs to.

    The codebook's own ids drift, so the normalised title decides. The first
    paper wins per title and the first coded row wins per paper; both are picked
    by aggregates before the join, so a title shared by many rows stays cheap.
    """
    columns = ["paper_id", *[c for c in coded.columns if c != "paper_id"]]
    rows = _keyed(coded.drop("paper_id")).where("_key <> ''")
    best = first_rows(rows, ["_key"], order)
    return best.join(_first_papers(papers).select("_key", "paper_id"), "_key").select(*columns)


def unaligned_rows(papers: DataFrame, coded: DataFrame) -> DataFrame:
    """Coded rows whose non-blank title belongs to no paper."""
    rows = _keyed(coded).where(strip(F.coalesce("title", F.lit(""))) != "")
    known = _first_papers(papers).where("_key <> ''").select("_key")
    return rows.join(known, "_key", "left_anti").drop("_key")


def duplicate_titles(papers: DataFrame) -> DataFrame:
    """Titles that several papers share, as rows ``(title, papers, first_paper)``; blank ones are no titles."""
    shared = _first_papers(papers).where((F.col("_key") != "") & (F.col("_papers") > 1))
    named = papers.select("paper_id", "title").join(shared, "paper_id")
    return named.select("title", F.col("_papers").alias("papers"), F.col("paper_id").alias("first_paper"))


def alignment_report(papers: DataFrame, coded: DataFrame) -> DataFrame:
    """One row: coded rows, matched papers, unmatched titles, dropped duplicates on both sides.

    Rows are counted per title before the join.
    """
    filled = strip(F.coalesce("title", F.lit(""))) != ""
    per_key = _keyed(coded).groupBy("_key").agg(
        F.count("*").alias("_rows"), F.count_if(filled).alias("_titled")
    )
    firsts = _first_papers(papers)
    known = firsts.select("_key", F.lit(True).alias("_known"))
    hit = F.col("_known").isNotNull() & (F.col("_key") != "")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    facts = per_key.join(known, "_key", "left").agg(
        total("_rows").alias("coded_rows"),
        F.count_if(hit).alias("matched"),
        total(F.when(~hit, F.col("_titled"))).alias("unmatched_count"),
        total(F.when(hit, F.col("_rows") - 1)).alias("duplicate_coded_rows_dropped"),
    )
    repeated = firsts.agg(total(F.col("_papers") - 1).alias("n")).scalar()
    return facts.withColumn("duplicate_paper_titles", repeated)


def join_papers_codes(papers: DataFrame, coded: DataFrame) -> DataFrame:
    """Every paper with its coded columns; clashing names get ``_coded``."""
    taken = [c for c in papers.columns if c != "paper_id"]
    codes = coded.drop("title")
    clashes = {c: f"{c}_coded" for c in codes.columns if c in taken}
    return papers.join(codes.withColumnsRenamed(clashes), "paper_id", "left")


def join_report(papers: DataFrame, coded: DataFrame) -> DataFrame:
    """One row: papers, coded rows, joined rows and titles that still disagree."""
    other = coded.select("paper_id", F.col("title").alias("_other"), F.lit(1).alias("_hit"))
    joined = papers.join(other, "paper_id", "left")
    differ = title_key(F.coalesce("title", F.lit(""))) != title_key(F.coalesce("_other", F.lit("")))
    return joined.agg(
        F.count("*").alias("joined"), F.count_if(F.col("_hit").isNotNull() & differ).alias("title_mismatches")
    ).withColumns(
        {
            "papers": papers.agg(F.count("*")).scalar(),
            "coded": coded.agg(F.count("*")).scalar(),
        }
    )


def tidy_codes(
    coded: DataFrame, dimensions: Sequence[str] = CODE_DIMENSIONS, sep: str = ";"
) -> DataFrame:
    """Wide code cells -> rows ``(paper_id, dimension, source, code)``; repeats are kept."""
    cells: list[Column] = []
    for d in (d.lower() for d in dimensions):
        for source in ("title_kw", "abstract"):
            if f"{d}_{source}" in coded.columns:
                codes = F.col(f"{d}_{source}").alias("codes")
                cells.append(F.struct(F.lit(d).alias("dimension"), F.lit(source).alias("source"), codes))
    if not cells:
        none = "paper_id long, dimension string, source string, code string"
        return coded.sparkSession.createDataFrame([], none)
    long = coded.select("paper_id", F.inline(F.array(*cells)))
    return long.select("paper_id", "dimension", "source", F.explode(split_codes("codes", sep)).alias("code"))
