"""Every stage against a plain version on the smallest tables, and the registered queries against their SQL."""

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from test_contamination import plain_score
from test_near import brute
from test_sharding_and_dedup import fold

import corpus_pipeline as pipeline
from sedge.llm import quality
from sedge.llm.queries import registry
from sedge.llm.scratch import materialized
from sedge.llm.tokens import WordTokens, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), SF, registry.queries[name], registry.sql[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries) - set(registry.sql)))
def test_queries_cover_their_table(spark, name):
    rows = registry.queries[name](spark, SF)
    assert rows.columns[0] == "doc_id"
    ids = {r[0] for r in rows.select("doc_id").collect()}
    documents = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids <= documents and (name.startswith("op10") or ids == documents)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(pipeline.STAGES):
        docs = materialized(stage(spark, docs, SF), f"test-stage-{number}")
        out.append(docs)
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns_stay(stages):
    assert [s.columns for s in stages[1:5]] == [stages[0].columns] * 4
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {k for k, _ in pairs(stages[1])}
    judged = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = ([k for k, q in judged.items() if q == v] for v in (1, 0))
    assert sum(k in kept for k in good) >= 0.95 * len(good) and sum(k in kept for k in bad) <= 0.3 * len(bad)
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = quality.fit_quality(stages[0], labels.filter((F.col("quality") == 1) & (fold_of != 1)), "doc_id", "text")
    plain = [k for k, t in pairs(stages[0]) if quality.sigmoid(model[0].logit(quality.np.array([quality.text_features(t)])))[0] >= 0.5]
    assert sorted(kept) == plain


def test_dedup_stage(stages):
    best = {}
    for k, t in pairs(stages[1]):
        best[fold(t)] = max(best.get(fold(t), k), k)
    assert sorted(k for k, _ in pairs(stages[2])) == sorted(best.values())


def test_near_stage(stages):
    assert [k for k, _ in pairs(stages[3])] == sorted({c for _, _, c in brute(pairs(stages[2]))})


def test_decontamination_stage(spark, stages):
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {k for k, _ in pairs(stages[4])}
    for k, t in pairs(stages[3]):
        own = words(t)
        shared = [i for i in items if len(set(i) & set(own)) >= 0.5 * len(set(i))]
        bad = any(plain_score(i, own) >= len(i) for i in shared)
        assert (k in kept) != bad


def test_packing_stage(stages):
    tokens = WordTokens(vocabulary_path())
    want = {k: len(tokens.encode(t)) // 4 + 1 for k, t in pairs(stages[4])}
    got = {}
    for r in stages[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_gives_the_last_stage(spark, stages):
    got = pipeline.run(spark, SF)
    assert got.columns == stages[5].columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in stages[5].collect())
