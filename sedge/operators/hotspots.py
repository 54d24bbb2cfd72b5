"""Counts over the coded corpus. A code counts once per paper, whatever its sources."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.functions.lexicon import GEO_LEVELS
from sedge.functions.text import split_list, strip
from sedge.operators.ordering import join_keys
from sedge.session import materialized

PAIRS_PER_TASK = 4_000_000
# Rows that one task compares or joins, so that its memory stays the same on larger tables.
ROWS_PER_TASK = 1_000_000


def code_frequencies(codes: DataFrame, dimension: str | None = None, top: int | None = None) -> DataFrame:
    """Papers per ``(dimension, code)``, most frequent first, ties by code."""
    rows = codes if dimension is None else codes.where(F.col("dimension") == dimension)
    known = F.count_if(F.col("paper_id").isNotNull()).alias("papers")
    counted = _distinct(rows).groupBy("dimension", "code").agg(known)
    ranking = [F.desc("papers"), F.asc("code")]
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("dimension").orderBy(*ranking))
        counted = counted.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")
    return counted.orderBy("dimension", *ranking)


def _distinct(codes: DataFrame) -> DataFrame:
    """Distinct ``(paper_id, dimension, code)``.

    Rows are dealt out by all three before they are compared: papers seldom repeat within a task, so tables made ahead of the
    shuffle would hold nearly every row of a task and save nothing.
    """
    names = ["paper_id", "dimension", "code"]
    return codes.select(*names).repartition(*names).distinct()


def code_by_sector(
    codes: DataFrame,
    papers: DataFrame,
    dimension: str,
    top: int = 15,
    sectors: Sequence[str] | None = None,
) -> DataFrame:
    """Papers per code and sector for one dimension, with the ``top`` codes by total.

    Named ``sectors`` become columns; without names the rows are ``(code, sector_tag, papers, total)``, of any
    number of sectors.
    """
    assigned = codes.where(F.col("dimension") == dimension).select("paper_id", "code").distinct()
    tagged = assigned.join(papers.select("paper_id", "sector_tag"), "paper_id").where("sector_tag is not null")
    if sectors is not None:
        named = [F.count_if(F.col("sector_tag") == s).alias(s) for s in sectors]
        return tagged.groupBy("code").agg(*named, F.count("*").alias("total")).orderBy(F.desc("total"), "code").limit(top)
    cells = tagged.groupBy("code", "sector_tag").agg(F.count("*").alias("papers"))
    best = cells.groupBy("code").agg(F.sum("papers").alias("total")).orderBy(F.desc("total"), "code").limit(top)
    return cells.join(best, "code").select("code", "sector_tag", "papers", "total").orderBy(F.desc("total"), "code", "sector_tag")


def _tasks(df: DataFrame, rows: int) -> int:
    """As many tasks as hold ``ROWS_PER_TASK`` each, at least the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_TASK))


def _frequent(codes: DataFrame, dimensions: Sequence[str], min_count: int) -> DataFrame:
    """Distinct ``(paper_id, dimension, code)`` of the codes that reach ``min_count`` papers.

    Codes with more than a task's rows (so few that they can be sent along) are picked out where their rows are; only the others' rows
    are shuffled by code.
    """
    known = F.col("paper_id").isNotNull() & F.col("code").isNotNull()
    names, at = ["paper_id", "dimension", "code"], ["dimension", "code"]
    chosen = codes.where(F.col("dimension").isin(*dimensions) & known).select(*names)
    tasks = _tasks(codes, chosen.count())
    assigned = materialized(chosen.repartition(tasks, *names).distinct(), "assigned-codes")
    counted = materialized(assigned.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count), "code-counts")
    hot = F.broadcast(counted.where(F.col("_n") > ROWS_PER_TASK // 10).select(*at))
    others = counted.where(F.col("_n") <= ROWS_PER_TASK // 10).select(*at).repartition(tasks, *at)
    rest = assigned.join(hot, at, "left_anti").repartition(tasks, *at).join(others, at, "left_semi")
    return assigned.join(hot, at, "left_semi").unionByName(rest.select(*names))


def code_cooccurrence(
    codes: DataFrame, dim_a: str, dim_b: str, min_count: int = 5, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Papers in which a code of each dimension appears, as rows ``(code_a, code_b, papers)``.

    Rare codes go before the join, and what is left is written once, since both
    sides of the join read it. A paper whose codes make more than
    ``pairs_per_task`` pairs is spread over salted parts: its first side is dealt
    out, its second side goes to every part, and each pair still meets once. Tasks
    are as many as the rows and pairs call for.
    """
    frequent = materialized(_frequent(codes, [dim_a, dim_b], min_count), "frequent-codes")
    side = lambda dim, name: frequent.where(F.col("dimension") == dim).select("paper_id", F.col("code").alias(name))
    a, b = side(dim_a, "code_a"), side(dim_b, "code_b")
    of = lambda dim: F.count_if(F.col("dimension") == dim)
    by_paper = frequent.repartition(_tasks(codes, frequent.count()), "paper_id")
    sizes = by_paper.groupBy("paper_id").agg((of(dim_a) * of(dim_b)).alias("_pairs")).where("_pairs > 0")
    sizes = materialized(sizes, "pair-counts")
    # Papers that are spread hold thousands of codes each, so they are few beside the rows.
    spread = F.broadcast(sizes.where(F.col("_pairs") > pairs_per_task).select("paper_id", F.ceil(F.col("_pairs") / pairs_per_task).cast("int").alias("_parts")))
    parts, meet = F.coalesce("_parts", F.lit(1)), ["paper_id", "_part"]
    dealt = a.join(spread, "paper_id", "left").select("paper_id", "code_a", F.pmod(F.xxhash64("code_a"), parts).cast("int").alias("_part"))
    copied = b.join(spread, "paper_id", "left").select("paper_id", "code_b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    tasks = _tasks(codes, sizes.agg(F.sum("_pairs")).first()[0] or 0)
    met = dealt.repartition(tasks, *meet).join(copied.repartition(tasks, *meet), meet)
    return met.groupBy("code_a", "code_b").agg(F.count("*").alias("papers"))


def cooccurrence_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide view of :func:`code_cooccurrence` for the given second codes."""
    cells = [F.coalesce(F.sum(F.when(F.col("code_b") == c, F.col("papers"))), F.lit(0)).alias(c) for c in columns]
    return pairs.groupBy("code_a").agg(*cells).orderBy("code_a")


def _count_values(papers: DataFrame, values: Column, name: str) -> DataFrame:
    """Papers per value of an array column; a value counts once per paper."""
    long = papers.select("paper_id", F.explode(F.array_distinct(values)).alias(name))
    return long.groupBy(name).agg(F.count_distinct("paper_id").alias("papers")).orderBy(F.desc("papers"), name)


def country_counts(papers: DataFrame, column: str = "countries_mentioned") -> DataFrame:
    """Papers per mentioned country, spelled as written."""
    return _count_values(papers, split_list(column, ","), "country")


def geo_level_counts(papers: DataFrame, column: str = "geographic_level") -> DataFrame:
    """Papers per geographic level with Italian and English spellings merged."""
    level = F.create_map(*[F.lit(x) for pair in GEO_LEVELS.items() for x in pair])
    parts = split_list(column, ",")
    named = F.transform(parts, lambda p: F.coalesce(F.try_element_at(level, F.lower(p)), p))
    return _count_values(
        papers, F.when(F.size(parts) == 0, F.array(F.lit("(unspecified)"))).otherwise(named), "geo_level"
    )


def _crosstab(rows: DataFrame, column: str, sectors: Sequence[str] | None) -> DataFrame:
    """Named sectors as columns, else one row per value and sector."""
    known = rows.where("sector_tag is not null")
    if sectors is None:
        return known.groupBy(column, "sector_tag").agg(F.count("*").alias("papers")).orderBy(column, "sector_tag")
    return known.groupBy(column).agg(*[F.count_if(F.col("sector_tag") == s).alias(s) for s in sectors]).orderBy(column)


def crosstab_by_sector(papers: DataFrame, column: str, sectors: Sequence[str] | None = None) -> DataFrame:
    """Papers per value of ``column`` and sector; blanks are ``(none)``."""
    text = strip(F.coalesce(F.col(column).cast("string"), F.lit("")))
    shown = F.when(text == "", F.lit("(none)")).otherwise(text)
    return _crosstab(papers.select(shown.alias(column), "sector_tag"), column, sectors)


def year_by_sector(papers: DataFrame, sectors: Sequence[str] | None = None) -> DataFrame:
    """Papers per publication year and sector; rows without year are left out."""
    rows = papers.where("year is not null").select(F.col("year").cast("int").alias("year"), "sector_tag")
    return _crosstab(rows, "year", sectors)


def corpus_summary(papers: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows ``(metric, value)``: number of papers, of codes and of papers per sector."""
    total = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    sectors = papers.where("sector_tag is not null").groupBy(
        F.concat(F.lit("sector:"), F.col("sector_tag")).alias("metric")
    ).agg(F.count("*").alias("value"))
    return total(papers, "papers").unionByName(total(codes, "codes")).unionByName(sectors)


def frequent_codes(codes: DataFrame, dimensions: Sequence[str], min_papers: int) -> DataFrame:
    """``(dimension, code)`` pairs assigned to at least ``min_papers`` papers."""
    chosen = codes.where(F.col("dimension").isin(*dimensions))
    counted = chosen.groupBy("dimension", "code").agg(F.count_distinct("paper_id").alias("papers"))
    return counted.where(F.col("papers") >= min_papers)


def code_targets(
    codes: DataFrame,
    papers: DataFrame,
    dimensions: Sequence[str] = ("barriers", "drivers", "stakeholders"),
    min_papers: int = 15,
) -> DataFrame:
    """Yes/no label of every paper for every frequent code: ``(paper_id, task, label)``.

    A paper's frequent codes are gathered first (no more than there are tasks),
    then the task list, read once as a scalar, is laid out beside each paper.
    """
    task = F.concat_ws(":", "dimension", "code").alias("task")
    kept = frequent_codes(codes, dimensions, min_papers)
    assigned = codes.join(kept.select("dimension", "code"), ["dimension", "code"], "left_semi")
    per_paper = assigned.select("paper_id", task).distinct().groupBy("paper_id").agg(
        F.collect_list("task").alias("_tasks")
    )
    tasks = kept.select(task).agg(F.sort_array(F.collect_list("task")).alias("t")).scalar()
    labeled = join_keys(papers.select("paper_id"), per_paper, ["paper_id"]).select(
        "paper_id", F.explode(tasks).alias("task"), F.coalesce("_tasks", F.array().cast("array<string>")).alias("_t")
    )
    label = F.when(F.array_contains(F.col("_t"), F.col("task")), "yes").otherwise("no")
    return labeled.select("paper_id", "task", label.alias("label"))
