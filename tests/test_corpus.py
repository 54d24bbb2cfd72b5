"""Paper list, codebook, alignment and counts."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sedge.operators import corpus, hotspots
from sedge.operators.coder import derive_targets


def raw_papers(spark):
    return spark.createDataFrame(
        [(10, "Paper Alpha", "2024", "Alta", "AGRI_EU", " "), (11, "Paper Beta", "2025", "Media", "MINING_EU", ""),
         (12, " ", "", "", "", None), (13, "Paper Gamma", "bad", "Bassa", "AGRI_OUT", "")],
        "row int, `Titolo articolo` string, `Anno di pubblicazione` string, `Rilevanza per X (Alta/Media/Bassa)` string, TIPO string, Vuota string",
    )


HEADERS = ["row", "paper_id", "Titolo articolo", "CE", "BIO", "BARRIERS", "DRIVERS", "STAKEHOLDERS", "Abstract", "OTHER",
           "CE", "BIO", "BARRIERS", "DRIVERS", "STAKEHOLDERS", "BUSINESS MODEL", "SPECIFIC REGION?", "TIPO"]


def raw_codebook(spark):
    data = [
        (0, "0", "Paper Alpha", "recycling", "", "cost; policy", "", "", "...", "", "reuse", "", "", "tech", "farmers", "", "Italy", "AGRI_EU"),
        (1, "5", "PAPER - gamma!", "", "", "data", "demand", "", "...", "", "", "", "funding", "", "", "", "", "AGRI_EU"),
        (2, "9", "Unknown Paper", "", "", "", "", "", "...", "", "", "", "", "", "", "", "", "X"),
        (3, "9.x", "Paper Beta", "", "", "", "", "", "...", "", "", "", "", "", "", "", "", "X"),
    ]
    names = ", ".join(f"c{i} {'int' if i == 0 else 'string'}" for i in range(len(HEADERS)))
    return spark.createDataFrame(data, names).toDF(*HEADERS)


def test_tidy_papers(spark):
    papers = corpus.tidy_papers(raw_papers(spark), ["row"]).orderBy("paper_id")
    assert papers.columns == ["paper_id", "row", "title", "year", "relevance", "sector_tag"]
    assert [(r["paper_id"], r["year"]) for r in papers.collect()] == [(0, 2024), (1, 2025), (2, None)]


def test_tidy_codebook_tells_columns_apart(spark):
    coded = corpus.tidy_codebook(raw_codebook(spark), ["row"])
    assert {"ce_title_kw", "ce_abstract", "barriers_title_kw", "barriers_abstract", "specific_region", "sector_tag"} <= set(coded.columns)
    assert not {"bio_title_kw", "other", "business_model"} & set(coded.columns)
    assert sorted(r["paper_id"] for r in coded.collect()) == [0, 5, 9]


def test_corpus_end_to_end(spark, rows):
    papers = corpus.tidy_papers(raw_papers(spark), ["row"])
    coded = corpus.tidy_codebook(raw_codebook(spark), ["row"])
    aligned = corpus.align_codebook(papers, coded, ["row"])
    assert sorted(r["paper_id"] for r in aligned.collect()) == [0, 2]
    report = corpus.alignment_report(papers, coded).first().asDict()
    assert report == {"coded_rows": 3, "matched": 2, "unmatched_count": 1, "duplicate_coded_rows_dropped": 0, "duplicate_paper_titles": 0}
    assert [r["title"] for r in corpus.unaligned_rows(papers, coded).collect()] == ["Unknown Paper"]
    assert rows(corpus.tidy_codes(aligned)) == [
        (0, "barriers", "title_kw", "cost"), (0, "barriers", "title_kw", "policy"), (0, "ce", "abstract", "reuse"),
        (0, "ce", "title_kw", "recycling"), (0, "drivers", "abstract", "tech"), (0, "stakeholders", "abstract", "farmers"),
        (2, "barriers", "abstract", "funding"), (2, "barriers", "title_kw", "data"), (2, "drivers", "title_kw", "demand"),
    ]
    joined = corpus.join_papers_codes(papers, aligned)
    assert joined.count() == 3 and {"sector_tag", "sector_tag_coded", "row_coded"} <= set(joined.columns)
    assert corpus.join_report(papers, aligned).first().asDict() == {"joined": 3, "title_mismatches": 0, "papers": 3, "coded": 2}


def test_alignment_first_wins_and_counts_duplicates(spark):
    papers = spark.createDataFrame([(0, "A b"), (1, "a-B"), (2, "c"), (3, "!!")], "paper_id long, title string")
    coded = spark.createDataFrame(
        [(3, "C", "z"), (1, "A  B", "x"), (2, "a b", "y"), (4, "??", "w"), (5, "  ", "v"), (6, None, "u")],
        "row int, title string, ce_title_kw string",
    )
    aligned = {r["paper_id"]: r["ce_title_kw"] for r in corpus.align_codebook(papers, coded, ["row"]).collect()}
    assert aligned == {0: "x", 2: "z"}
    report = corpus.alignment_report(papers, coded).first()
    assert (report["matched"], report["unmatched_count"], report["duplicate_coded_rows_dropped"], report["duplicate_paper_titles"]) == (2, 1, 1, 1)
    assert [r["title"] for r in corpus.unaligned_rows(papers, coded).collect()] == ["??"]


def test_tidy_codes_without_code_columns(spark):
    assert corpus.tidy_codes(spark.createDataFrame([(1,)], "paper_id long")).count() == 0


def papers(spark):
    return spark.createDataFrame(
        [(0, "AGRI_EU", "Italy, Germany", "Nazionale", "Alta", 2024), (1, "AGRI_EU", "Italy", "NUTS 2, Nazionale", None, 2024),
         (2, "MINING_EU", None, None, "Media", 2025), (3, "AGRI_OUT", "Kenya", "National", None, 2023)],
        "paper_id long, sector_tag string, countries_mentioned string, geographic_level string, relevance string, year int",
    )


def codes(spark):
    return spark.createDataFrame(
        [(0, "barriers", "title_kw", "cost"), (0, "barriers", "abstract", "cost"), (1, "barriers", "title_kw", "cost"),
         (2, "barriers", "title_kw", "policy"), (0, "drivers", "abstract", "demand"), (1, "drivers", "abstract", "demand"),
         (3, "stakeholders", "title_kw", "farmers")],
        "paper_id long, dimension string, source string, code string",
    )


def test_code_counts_once_per_paper(spark):
    got = [tuple(r) for r in hotspots.code_frequencies(codes(spark)).collect()]
    assert got == [("barriers", "cost", 2), ("barriers", "policy", 1), ("drivers", "demand", 2), ("stakeholders", "farmers", 1)]
    assert [r["code"] for r in hotspots.code_frequencies(codes(spark), "barriers", 1).collect()] == ["cost"]


SECTORS = ["AGRI_EU", "AGRI_OUT", "MINING_EU"]


def test_code_by_any_number_of_sectors(spark):
    got = [tuple(r) for r in hotspots.code_by_sector(codes(spark), papers(spark), "barriers").collect()]
    assert got == [("cost", "AGRI_EU", 2, 2), ("policy", "MINING_EU", 1, 1)]


def test_code_by_sector(spark):
    got = [r.asDict() for r in hotspots.code_by_sector(codes(spark), papers(spark), "barriers", 15, SECTORS).collect()]
    assert got == [
        {"code": "cost", "AGRI_EU": 2, "AGRI_OUT": 0, "MINING_EU": 0, "total": 2},
        {"code": "policy", "AGRI_EU": 0, "AGRI_OUT": 0, "MINING_EU": 1, "total": 1},
    ]


def test_cooccurrence_is_symmetric(spark, rows):
    one = rows(hotspots.code_cooccurrence(codes(spark), "barriers", "drivers", 1))
    other = rows(hotspots.code_cooccurrence(codes(spark), "drivers", "barriers", 1))
    assert one == [("cost", "demand", 2)] and [(b, a, n) for a, b, n in other] == one
    assert hotspots.code_cooccurrence(codes(spark), "barriers", "drivers", 3).count() == 0


def test_cooccurrence_with_a_hot_paper_split_up(spark, rows):
    """One paper holds a third of all rows; its pairs are spread over parts and counted once."""
    rng = random.Random(2)
    data = [(0, d, f"{d[0]}{i}") for d in ("barriers", "drivers") for i in range(60)]
    data += [(rng.randrange(1, 40), rng.choice(("barriers", "drivers")), None) for _ in range(240)]
    data = [(p, d, "x", c or f"{d[0]}{rng.randrange(60)}") for p, d, c in data]
    df = spark.createDataFrame(data, "paper_id long, dimension string, source string, code string")
    a, b = ({(p, c) for p, d, _, c in data if d == dim} for dim in ("barriers", "drivers"))
    keep = lambda side: {c for c, n in Counter(c for _, c in side).items() if n >= 2}
    ka, kb = keep(a), keep(b)
    want = Counter((x, y) for p, x in a for q, y in b if p == q and x in ka and y in kb)
    got = hotspots.code_cooccurrence(df, "barriers", "drivers", 2, pairs_per_task=50)
    assert rows(got) == sorted(((x, y, n) for (x, y), n in want.items()), key=repr)


def test_cooccurrence_tasks_grow_with_the_rows(spark, rows, monkeypatch):
    """No task compares or joins more rows than stated, and codes with many papers are picked out without a shuffle by code."""
    data = [(p, d, "x", f"{d[0]}{(p * k) % 7}") for p in range(60) for k in range(1, 4) for d in ("barriers", "drivers")]
    df = spark.createDataFrame(data + data[:50], "paper_id long, dimension string, source string, code string")
    want = rows(hotspots.code_cooccurrence(df, "barriers", "drivers", 5))
    made, repartition = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *by: made.append(n) or repartition(self, n, *by))
    monkeypatch.setattr(hotspots, "ROWS_PER_TASK", 20)
    assert rows(hotspots.code_cooccurrence(df, "barriers", "drivers", 5)) == want and want
    assert made[0] == math.ceil((len(data) + 50) / 20) and min(made) >= 16


def test_places(spark):
    assert [tuple(r) for r in hotspots.country_counts(papers(spark)).collect()] == [("Italy", 2), ("Germany", 1), ("Kenya", 1)]
    assert [tuple(r) for r in hotspots.geo_level_counts(papers(spark)).collect()] == [("National", 3), ("(unspecified)", 1), ("NUTS 2", 1)]


def test_crosstabs(spark):
    got = [tuple(r) for r in hotspots.crosstab_by_sector(papers(spark), "relevance", SECTORS).collect()]
    assert got == [("(none)", 1, 1, 0), ("Alta", 1, 0, 0), ("Media", 0, 0, 1)]
    assert [tuple(r) for r in hotspots.year_by_sector(papers(spark), SECTORS).collect()] == [(2023, 0, 1, 0), (2024, 2, 0, 0), (2025, 0, 0, 1)]


def test_summary(spark):
    got = {r["metric"]: r["value"] for r in hotspots.corpus_summary(papers(spark), codes(spark)).collect()}
    assert got == {"papers": 4, "codes": 7, "sector:AGRI_EU": 2, "sector:AGRI_OUT": 1, "sector:MINING_EU": 1}


def test_many_sectors_are_rows(spark):
    many = spark.range(700).select(F.col("id").alias("paper_id"), F.col("id").cast("string").alias("sector_tag"))
    got = hotspots.crosstab_by_sector(many.withColumn("v", F.lit("x")), "v")
    assert got.columns == ["v", "sector_tag", "papers"] and got.count() == 700


def test_code_targets(spark, rows):
    data = [(i, "barriers", "cost") for i in range(4)] + [(i, "drivers", "demand") for i in range(2)]
    df = spark.createDataFrame(data, "paper_id long, dimension string, code string")
    got = rows(hotspots.code_targets(df, spark.range(6).withColumnRenamed("id", "paper_id"), min_papers=3))
    assert got == [(i, "barriers:cost", "yes" if i < 4 else "no") for i in range(6)]


def test_targets(spark):
    df = spark.createDataFrame(
        [(0, "AGRI_EU", "Alta"), (1, "MINING_EU", "Molto Alta"), (2, "MIN_OUT", "Media"), (3, "AGRI_OUT", "Bassa"), (4, "", "Media/Alta"), (5, None, None)],
        "paper_id long, sector_tag string, relevance string",
    )
    got = {(r["task"], r["paper_id"]): r["label"] for r in derive_targets(df).collect()}
    of = lambda task: [got[task, i] for i in range(6)]
    assert of("sector") == ["agri", "mining", "mining", "agri", None, None]
    assert of("region") == ["eu", "eu", "out", "out", None, None]
    assert of("relevance") == ["high", "high", "medium_low", "medium_low", "high", None]


def test_papers_are_dealt_out_before_they_are_compared(spark):
    from sedge.operators import hotspots

    codes = spark.createDataFrame([(1, "d", "a"), (1, "d", "a"), (2, "d", "a"), (None, "d", "b"), (3, "e", "a")], "paper_id long, dimension string, code string")
    found = hotspots.code_frequencies(codes)
    assert [tuple(r) for r in found.collect()] == [("d", "a", 2), ("d", "b", 0), ("e", "a", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "distinct" not in plan.split("Aggregate")[1]
