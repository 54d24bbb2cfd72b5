"""The standard jobs from landed tables to result tables, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.functions.columns import resolve_roles, scenario_variables
from sedge.functions.lexicon import PROXY_ASSUMPTIONS
from sedge.functions.text import paper_text
from sedge.operators import cleaning, coder, corpus, hotspots, regress, splitting, sweep
from sedge.sources import provenance, tables


def prepare_literature(papers: DataFrame, codebook: DataFrame, order: Sequence[str], folder: str) -> DataFrame:
    """Landed paper list and codebook -> ``papers.csv``, ``codes_long.csv``, ``papers_coded.csv``; returns the report."""
    tidy = corpus.tidy_papers(papers, order)
    coded = corpus.tidy_codebook(codebook, order)
    aligned = corpus.align_codebook(tidy, coded, order)
    long = corpus.tidy_codes(aligned)
    joined = corpus.join_papers_codes(tidy, aligned)
    tables.write_tables({"papers.csv": tidy, "codes_long.csv": long, "papers_coded.csv": joined}, folder)
    checked = corpus.join_report(tidy, aligned).select(F.struct("papers", "joined", "title_mismatches").alias("j")).scalar()
    return corpus.alignment_report(tidy, coded).select("*", F.inline(F.array(checked)))


def literature_tables(
    papers: DataFrame, codes: DataFrame, top: int = 15, min_pairs: int = 8, sectors: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The standard result tables over papers and long codes."""
    by_sector = {
        f"lit_{d}_by_sector": hotspots.code_by_sector(codes, papers, d, top, sectors)
        for d in ("barriers", "drivers", "stakeholders")
    }
    return {
        "lit_top_codes": hotspots.code_frequencies(codes, top=top),
        "lit_country_counts": hotspots.country_counts(papers),
        "lit_geo_levels": hotspots.geo_level_counts(papers),
        "lit_relevance_by_sector": hotspots.crosstab_by_sector(papers, "relevance", sectors),
        "lit_year_by_sector": hotspots.year_by_sector(papers, sectors),
        **by_sector,
        "lit_cooccurrence_barriers_drivers": hotspots.code_cooccurrence(codes, "barriers", "drivers", min_pairs),
    }


def analyze_literature(spark: SparkSession, folder: str, results: str, run_log: str | None = None) -> dict[str, str]:
    """Read papers and codes, write every standard table; returns their paths."""
    papers, codes = tables.read_literature(spark, folder)
    written = tables.write_tables(literature_tables(papers, codes), results)
    if run_log:
        summary = {r["metric"]: r["value"] for r in hotspots.corpus_summary(papers, codes).collect()}
        provenance.append_run_log(spark, run_log, "literature_analytics", {**summary, "tables": written})
    return written


def train_coders(spark: SparkSession, folder: str, models: str, min_papers: int = 15, cv: int = 5, **options) -> coder.Coding:
    """Sector, region, relevance and one task per frequent code: compare, refit and save the best model of each."""
    papers, codes = tables.read_literature(spark, folder)
    by_code = hotspots.code_targets(codes, papers, min_papers=min_papers)
    named = by_code.withColumn("task", F.concat(F.lit("code:"), "task"))
    targets = coder.derive_targets(papers).unionByName(named)
    abstract = "abstract" if "abstract" in papers.columns else None
    texts = papers.select("paper_id", paper_text("title", abstract).alias("text"))
    return coder.run_coding(texts, targets, models, cv=cv, **options)


def prepare_sensor(
    raw: DataFrame,
    features: Sequence[str],
    target: str,
    id_columns: Sequence[str],
    order: Sequence[str],
    folder: str,
    strict: bool = True,
    **options,
) -> cleaning.Prepared:
    """Raw sensor table -> cleaned rows, written by split. With ``strict`` any problem is an error."""

    def stop_on(problems: DataFrame) -> None:
        found = [r["detail"] for r in problems.collect()]
        if found and strict:
            raise ValueError("; ".join(found))

    stop_on(cleaning.raw_problems(raw))
    columns, y, clock = resolve_roles(raw.columns, features, target)
    done = cleaning.prepare(raw, columns, y, id_columns, clock=clock, order=order, **options)
    tables.write_splits(done.df, folder)
    done.df = raw.sparkSession.read.parquet(folder)
    stop_on(cleaning.prepared_problems(done.df, done.features, done.target))
    return done


def train_and_sweep(
    done: cleaning.Prepared,
    id_columns: Sequence[str],
    results: str,
    points: int = 25,
    config: Mapping | None = PROXY_ASSUMPTIONS,
    **options,
) -> regress.Trained:
    """Leaderboard, predictions of the best model and its one-way sweep around one validation row."""
    trained = regress.train_models(done.df, done.features, done.target, id_columns, **options)
    base = done.df.where("split = 'validation'")
    first = base.orderBy(splitting.row_hash(id_columns, 0)).limit(1)
    swept = sweep.run_sweep(
        trained.best_model, base.select(*[f"`{c}`" for c in done.features]), first.select(*[f"`{c}`" for c in done.features]),
        scenario_variables(done.features), points, config,
    )
    tables.write_tables(
        {
            "model_comparison": trained.leaderboard,
            f"predictions_{trained.best_name}": trained.predictions,
            f"scenario_results_oneway_{trained.best_name}": swept,
        },
        results,
    )
    return trained
