"""Documents, search, terms and portfolios."""

import json

import pytest
from pyspark.sql import functions as F

from sedge.operators import finder, portfolio, terms


def grants(spark, *records):
    raw = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return finder.parse_records(raw, finder.GRANT_RECORD)


OVERVIEW = json.dumps({"budgetTopicActionMap": {"X": [{"action": "IA", "budget": "9 000 000"}]}})


@pytest.mark.parametrize(
    "meta, budget",
    [({"budget": ["12000000"]}, 12000000), ({"budgetOverviewJSONItem": [OVERVIEW]}, 9000000), ({"budget": ["42"]}, None),
     ({"budget": ["not a number"]}, None), ({}, None), ({"budget": "2500.5"}, 2500), ({"budget": ["3501.5"]}, 3502),
     ({"budget": ["5"], "cftEstimatedTotalProcedureValue": ["EUR 7,000"]}, 7000), ({"budget": ["1.2.3"], "budgetOverview": [OVERVIEW]}, 9000000),
     ({"budget": []}, None), ({"budgetOverview": ["budget: 5000"]}, None), ({"budget": [None]}, None)],
)
def test_budget(spark, meta, budget):
    df = grants(spark, {"metadata": meta})
    assert df.select(finder.budget_eur(F.coalesce("metadata", F.create_map().cast("map<string,string>")))).first()[0] == budget


def test_normalize_grant(spark):
    df = grants(
        spark,
        {"metadata": {"identifier": ["HORIZON-CL6-01"], "title": ["<b>Circular</b>  solutions"], "description": ["Bio-based   value chains." + " x" * 400],
                      "startDate": ["2025-09-15T00:00:00.000+0200"], "type": ["1"], "budget": ["12000000"]}},
        {},
        {"reference": "", "url": "http://u", "title": "", "content": "c", "metadata": {"type": "2", "identifier": [""]}},
    )
    full, empty, sparse = finder.normalize_grants(df).collect()
    assert (full["id"], full["title"], full["date"], full["budgetEUR"], full["doctype"]) == (
        "g:HORIZON-CL6-01", "Circular solutions", "2025-09-15", 12000000, "Call topic")
    assert full["url"].endswith("topic-details/horizon-cl6-01") and len(full["summary"]) == 823
    assert len(finder.normalize_grants(df, summary_length=600).collect()[0]["summary"]) == 600
    assert (empty["id"], empty["budgetEUR"], empty["date"], empty["summary"]) == ("g:", None, None, "")
    assert (sparse["id"], sparse["title"], sparse["summary"], sparse["doctype"]) == ("g:http://u", "http://u", "c", "Tender")


def policies(spark, *records):
    raw = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return finder.normalize_policies(finder.parse_records(raw, finder.POLICY_RECORD))


def binding(**changes):
    base = {"work": "http://cellar/abc", "title": "European Climate Law", "date": "2021-06-30", "type": "http://types/REG", "celex": "32021R1119"}
    return {k: {"value": v} for k, v in {**base, **changes}.items() if v is not None}


def test_normalize_policy(spark):
    with_number, without, empty = policies(spark, binding(), binding(celex=None, title="<i>T</i>"), {}).collect()
    assert (with_number["id"], with_number["doctype"], with_number["date"]) == ("p:32021R1119", "REG", "2021-06-30")
    assert with_number["url"].endswith("CELEX:32021R1119")
    assert (without["id"], without["url"], without["title"]) == ("p:http://cellar/abc", "http://cellar/abc", "T")
    assert (empty["id"], empty["doctype"], empty["date"]) == ("p:", "Act", None)


def test_search_policies(spark):
    docs = policies(
        spark, binding(celex="1", title="Soil law"), binding(celex="2", title="SOIL act", date="2022-01-01"), binding(celex="1", title="Soil law"),
        binding(celex="3", title="Soil", date="2014-12-31"), binding(celex="4", title="Soil", type="http://types/OPIN"), binding(celex="5", title="Air"),
    )
    assert [r["id"] for r in finder.search_policies(docs, ['so"il']).collect()] == ["p:2", "p:1"]
    assert [r["id"] for r in finder.search_policies(docs, ["soil"], limit=1).collect()] == ["p:2"]


def test_search_grants(spark):
    make = lambda i, status, kind="1", text="about soil": {"metadata": {"identifier": [i], "status": [status], "type": [kind], "description": [text]}}
    df = grants(spark, make("a", "31094501"), make("b", "31094503"), make("a", "31094502", text="SOIL again"), make("c", "9"),
                make("d", "31094501", "2"), make("e", "31094501", text="air"))
    df = df.withColumn("_landed", F.monotonically_increasing_id())
    out = finder.search_grants(df.coalesce(1), ["_landed"], ["Soil"])
    assert [(r["id"], r["summary"]) for r in out.collect()] == [("g:b", "about soil"), ("g:a", "about soil")]
    assert out.columns == finder.DOCUMENT_COLUMNS


def docs_of(spark, *rows):
    return spark.createDataFrame([(str(i), k, t, "") for i, (k, t) in enumerate(rows)], "id string, kind string, title string, summary string")


def test_bridge_topics_prune_and_keywords(spark):
    docs = docs_of(
        spark, ("policy", "circular economy soil"), ("policy", "circular economy water"), ("grant", "circular economy soil"), ("grant", "soil water"),
    )
    got = {r["term"]: (r["df_policy"], r["df_grant"], r["score"]) for r in terms.bridge_topics(docs, ["Water", "circular", "air"]).collect()}
    # The single words of the equally frequent bigram go; "circular" comes back as a keyword with score 0.
    # "soil" goes as well, for "economy soil" scores the same; "water" has no shared bigram.
    assert got["circular economy"] == (2, 1, 0.5) and got["economy soil"] == (1, 1, 0.5) and got["water"] == (1, 1, 0.5)
    assert got["circular"] == (2, 1, 0.0) and not {"economy", "soil", "air"} & set(got)


def test_top_terms_least_frequency(spark):
    few = docs_of(spark, ("policy", "alpha beta"), ("grant", "gamma"))
    assert {(r["kind"], r["term"], r["df"]) for r in terms.top_terms(few).collect()} == {("policy", "alpha beta", 1), ("grant", "gamma", 1)}
    many = docs_of(spark, *[("policy", f"alpha word{chr(97 + i)}") for i in range(13)])
    assert [(r["term"], r["df"]) for r in terms.top_terms(many).collect()] == [("alpha", 13)]


def test_topic_bundles(spark):
    docs = docs_of(spark, ("policy", "Topsoil"), ("grant", "soil"), ("grant", "air"))
    got = {r["topic"]: (r["policies"], r["grants"]) for r in terms.topic_bundles(docs, ["soil", "x y"]).collect()}
    assert got == {"soil": (1, 1), "x y": (0, 0)}
    assert terms.topic_documents(docs, ["soil", "air"]).count() == 3


def test_tfidf_by_hand(spark):
    import math

    df = spark.createDataFrame([(0, "ab ab cd"), (1, "ab the cd"), (2, "")], "id long, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(df, "id", "t", stopwords=["the"]).collect()}
    one = math.log(4 / 3) + 1
    first = {"ab": (1 + math.log(2)) * one, "cd": one, "ab cd": one}
    length = math.sqrt(sum(v * v for v in first.values()))
    assert set(got) == {(0, t) for t in first} | {(1, t) for t in first}
    assert all(math.isclose(got[0, t], v / length) for t, v in first.items())
    assert terms.tfidf(df, "id", "t", vocabulary=1, stopwords=[]).select("term").distinct().first()[0] == "ab"


ENTRY = {"topic": "Soil", "match_terms": ["soil"], "score": 14, "gtco2e_yr": [1.5, 4.0], "example_tasks": ["a", "b", "c"]}
ENABLER = {"topic": "Data", "match_terms": ["digital", "data space"], "score": 2, "gtco2e_yr": [0.0, 0.0], "example_tasks": ["x"]}
SAVER = {"driver": "Waste", "match_terms": ["waste"], "save_eur_yr": [1000, 3_500_000]}


def metrics_of(spark, rows, scenarios=None):
    docs = spark.createDataFrame(rows, "scenario string, kind string, budgetEUR long, source string, text string")
    return portfolio.scenario_metrics(docs, scenarios, [ENTRY, ENABLER], [SAVER])


def test_scenario_metrics_by_hand(spark):
    rows = [("s", "grant", 10, "live", "soil and digital"), ("s", "grant", 0, "live", "waste"), ("s", "grant", None, "cache", ""),
            ("s", "policy", 99, "live", "biosoil"), ("t", "policy", None, "live", "digital"), ("t", "policy", None, "live", None)]
    got = {r["scenario"]: r for r in metrics_of(spark, rows).collect()}
    s, t = got["s"], got["t"]
    assert (s["n_policies"], s["n_grants"], s["funding_low_eur"], s["funding_high_eur"], s["funding_unknown"]) == (1, 3, 3, 10, 2)
    assert (s["co2_index"], s["co2_low_gt"], s["co2_high_gt"], s["matched_topics"]) == (16, 1.5, 4.0, ["Soil", "Data"])
    assert (s["save_low_eur"], s["save_high_eur"], s["matched_savers"]) == (1000, 3_500_000, ["Waste"])
    # 75 - round(40 * 2/3) - 10 (four documents) - 5 (a cached one)
    assert (s["confidence"], s["confidence_label"]) == (33, "Low")
    assert s["example_tasks"][0]["topic"] == "Soil" and s["example_tasks"][0]["tasks"] == ["a", "b"]
    # 75 - 40 (no grants) - 25 (two documents) - 10 (only enabling topics), not below 5
    assert (t["confidence"], t["sectoral_topics"], t["co2_index"]) == (5, [], 2)


def test_topics_count_without_documents(spark):
    scenarios = spark.createDataFrame([("s", ["Data Space"]), ("u", ["SOIL"]), ("v", [])], "scenario string, topics array<string>")
    got = {r["scenario"]: r for r in metrics_of(spark, [("s", "grant", 2000, "live", "soil")], scenarios).collect()}
    assert got["s"]["matched_topics"] == ["Soil", "Data"] and got["u"]["matched_topics"] == ["Soil"] and got["v"]["matched_topics"] == []
    assert got["u"]["n_grants"] == 0 and got["u"]["funding_high_eur"] == 0


def test_recommendation_words(spark):
    rows = [("s", "grant", 1_250_000, "live", "soil waste")] + [("s", "grant", 4_000_000_000, "live", "x")] * 5
    text = portfolio.with_recommendation(metrics_of(spark, rows)).first()["recommendation"]
    assert "6 Horizon topics" in text and "€5,000.3–20,001.3 M" in text and "make this the technical core" in text
    assert "steps for soil: (1) a; (2) b." in text and "from waste (indicative €0–3.5 M/yr" in text
    assert "Confidence: High (75/75" in text and "adding budget" not in text
    lone = portfolio.with_recommendation(metrics_of(spark, [("s", "policy", None, "cache", "")])).first()["recommendation"]
    assert lone.startswith("This scenario contains no grants yet") and "1 matching policy " in lone and "including more matching" in lone


def ranked(spark, rows):
    return spark.createDataFrame(
        rows, "portfolio string, scenario string, idx long, funding_low_eur long, funding_high_eur long, co2_index long, save_low_eur long, save_high_eur long"
    )


def test_best_scenario_rank_sum(spark):
    rows = [("p", "a", 0, 5, 10, 1, 0, 0), ("p", "b", 1, 5, 10, 9, 0, 5), ("p", "c", 2, 1, 90, 2, 0, 5), ("q", "z", 0, 0, 0, 0, 0, 0)]
    got = {r["portfolio"]: (r["scenario"], r["rank_sum"], r["scenarios"]) for r in portfolio.best_scenario(ranked(spark, rows), "idx", ["portfolio"]).collect()}
    assert got == {"p": ("b", 2, 3), "q": ("z", 0, 1)}


def test_rank_sum_in_ranges_equals_plain(spark, rows):
    data = [("hot" if i % 3 else "p", f"s{i}", i, i * 7 % 5, i % 4, i % 3, 0, i % 2) for i in range(300)]
    plain = portfolio.rank_sums(ranked(spark, data), "idx", ["portfolio"])
    cut = portfolio.rank_sums(ranked(spark, data), "idx", ["portfolio"], ranges=9)
    assert rows(plain.select("scenario", "rank_sum")) == rows(cut.select("scenario", "rank_sum"))


def test_export_has_fifteen_columns(spark):
    out = portfolio.metrics_export(metrics_of(spark, [("s", "grant", 2000, "live", "soil digital")]))
    assert len(out.columns) == 15 and out.first()["matched_topics"] == "Soil; Data"


def test_keywords_behind_a_long_start_are_found(spark):
    df = grants(spark, {"metadata": {"identifier": ["A"], "title": ["t"], "description": ["x " * 500 + "rareword"], "type": ["1"], "status": ["31094501"]}})
    hits = finder.search_grants(df, ["url"], ["rareword"], types=["1"], statuses=["31094501"], summary_length=20).collect()
    assert [(r["id"], len(r["summary"])) for r in hits] == [("g:A", 20)]


def test_policies_keep_one_row_per_id(spark):
    rows = [(k, "p:3X", "policy", t, "", "2020-01-01", "u", None, "REG", "cache") for k, t in enumerate(["second soil", "first soil", "no hit"])]
    docs = spark.createDataFrame(rows, f"_landed int, {finder.DOCUMENT}")
    hits = finder.search_policies(docs, ["soil"], order=["_landed"]).collect()
    assert [(r["id"], r["title"]) for r in hits] == [("p:3X", "second soil")]


def physical(df):
    """The physical plan as text, none of it cut off."""
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", kept)


def test_texts_are_split_once(spark):
    """No filter that Spark adds for a list repeats the regex that made it; lists need no shuffle."""
    from sedge.operators import terms as operators
    from sedge.plans import documents as plans

    folder = "/root/testdata/sf0.001"
    docs = plans.documents(spark, folder)
    for df in (operators.document_terms(docs), operators.term_frequencies(docs), plans.doc_terms(spark, folder)):
        assert physical(df).count("regexp_extract_all(") == 1
    assert physical(plans.doc_terms(spark, folder)).count("Exchange") == physical(docs).count("Exchange")


def test_counted_texts_are_split_once(spark):
    from sedge.operators import text_models

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert physical(text_models.term_counts(texts, "doc_id", "text", ["the"])).count("regexp_extract_all(") == 1
