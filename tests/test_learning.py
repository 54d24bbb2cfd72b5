"""Regressors and text coders."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions.text import paper_text
from sedge.operators import coder, regress
from sedge.operators.hotspots import code_targets
from sedge.operators.splitting import hash_split
from sedge.operators.sweep import run_sweep
from sedge.session import scratch_path


@pytest.fixture(scope="module")
def sensor(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.uniform(0, 1000, 240), rng.uniform(20, 250, 240), rng.uniform(0, 5, 240)])
    y = 0.01 * x[:, 1] + 0.5 * x[:, 2] + rng.normal(0, 0.1, 240)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, time_s double, temperature double, Stiring double, pressure double")
    return hash_split(df, ["id"]).cache()


FEATURES = ["time_s", "temperature", "Stiring"]


def test_leaderboard_and_predictions(sensor):
    done = regress.train_models(
        sensor, FEATURES, "pressure", ["id"], enabled=["linreg", "rf", "unknown"], folds=3,
        grids={"rf": {"n_estimators": [5], "max_depth": [None, 3], "min_samples_split": [2]}},
    )
    board = done.leaderboard.collect()
    assert [r["model"] for r in board] == ["linreg", "rf"] and done.best_name == "linreg"
    assert board[0]["rmse_val"] <= board[1]["rmse_val"] and board[0]["r2_val"] > 0.9
    assert json.loads(board[1]["best_params"])["n_estimators"] == 5
    counts = {r[0]: r[1] for r in done.predictions.groupBy("split").count().collect()}
    assert counts == {r[0]: r[1] for r in sensor.where("split <> 'train'").groupBy("split").count().collect()}
    out = run_sweep(done.best_model, sensor.select(*FEATURES), sensor.select(*FEATURES).limit(1), ["temperature"], 5)
    assert out.count() == 5 and out.orderBy("_val").toPandas()["y_pred"].is_monotonic_increasing


def test_no_known_model_is_an_error(sensor):
    with pytest.raises(ValueError):
        regress.train_models(sensor, FEATURES, "pressure", ["id"], enabled=["unknown_only"])


def elastic_net(x, y, alpha, ratio, steps=20_000):
    """Plain coordinate descent for 1/(2n)|y-Xw|^2 + alpha*ratio*|w| + alpha*(1-ratio)/2*w^2."""
    w, n = np.zeros(x.shape[1]), len(y)
    for _ in range(steps // len(w)):
        for j in range(len(w)):
            r = y - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (x[:, j] @ x[:, j] / n + alpha * (1 - ratio))
    return w


@pytest.mark.parametrize("alpha, ratio", [(0.01, 0.1), (0.1, 0.5), (1.0, 0.1), (0.1, 0.9)])
def test_elastic_net_penalty_matches_coordinate_descent(sensor, alpha, ratio):
    done = regress.train_models(sensor, FEATURES, "pressure", ["id"], enabled=["enet"], grids={"enet": {"alpha": [alpha], "l1_ratio": [ratio]}})
    rows = sensor.toPandas()
    train = rows[rows["split"] == "train"]
    mean, std = train[FEATURES].mean(), train[FEATURES].std(ddof=0)
    w = elastic_net(((train[FEATURES] - mean) / std).to_numpy(), (train["pressure"] - train["pressure"].mean()).to_numpy(), alpha, ratio)
    want = ((rows[FEATURES] - mean) / std).to_numpy() @ w + train["pressure"].mean()
    got = done.best_model.transform(sensor).orderBy("id").toPandas()["y_pred"]
    assert np.allclose(got, want[np.argsort(rows["id"])], atol=0.01)


def corpus(spark, n=15):
    agri = ["crop soil harvest farm fertilizer yield wheat livestock pasture", "agriculture irrigation grain manure tractor field organic"]
    mine = ["ore mining excavation coal quarry mineral tailings drilling", "extraction pit lignite copper smelting geology seam blast"]
    rows = [(i, f"agri paper {i}", agri[i % 2], "AGRI_EU", "Alta" if i % 2 else "Media") for i in range(n)]
    rows += [(n + i, f"mine paper {i}", mine[i % 2], "MIN_OUT", "") for i in range(n)]
    return spark.createDataFrame(rows, "paper_id long, title string, abstract string, sector_tag string, relevance string")


def test_coding_end_to_end(spark):
    papers = corpus(spark)
    codes = spark.createDataFrame([(i, "barriers", "cost") for i in range(10)], "paper_id long, dimension string, code string")
    targets = coder.derive_targets(papers).unionByName(
        code_targets(codes, papers, min_papers=5).select("paper_id", F.concat(F.lit("code:"), "task").alias("task"), "label")
    ).unionByName(papers.select("paper_id", F.lit("lonely").alias("task"), F.lit("same").alias("label")))
    texts = papers.select("paper_id", paper_text("title", "abstract").alias("text"))
    folder = scratch_path(spark, "test-coder")
    done = coder.run_coding(texts, targets, folder, models=["logreg", "nb", "rf"], cv=3, trees=5)
    assert set(done.models) == {"sector", "region", "relevance", "code:barriers:cost"}
    assert "fewer than 2 classes" in done.skipped["lonely"]
    best = {r["task"]: r for r in done.best.collect()}
    assert best["sector"]["f1_macro"] > 0.9 and best["sector"]["cv_folds"] == 3 and best["sector"]["n"] == 30
    new = spark.createDataFrame([("ore coal mining pit", "quarry mineral"), ("farm crop soil", None)], "title string, abstract string")
    got = coder.predict_codes(folder, new, paper_text("title", "abstract")).collect()
    assert [r["pred_sector"] for r in got] == ["mining", "agri"]


def test_linear_svc_separates(spark):
    papers = corpus(spark)
    rows = papers.select("paper_id", paper_text("title", "abstract").alias("text"),
                         F.when(F.col("sector_tag") == "AGRI_EU", "agri").otherwise("mining").alias("label"))
    done = coder.evaluate_task(rows, "sector", models=["linear_svc"], cv=5)
    assert done.folds == 5
    assert coder.cv_summary(coder.fold_scores(done.predictions)).first()["f1_macro"] > 0.9


def test_folds_shrink_to_the_rarest_class(spark):
    rows = spark.createDataFrame([(i, "alpha beta gamma", "a" if i < 3 else "b") for i in range(20)], "paper_id long, text string, label string")
    assert coder.evaluate_task(rows, "t", models=["nb"], cv=10).folds == 3
    with pytest.raises(ValueError):
        coder.evaluate_task(rows.where("paper_id >= 2"), "t", models=["nb"])


def test_folds_are_balanced_per_class(spark):
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(100)], "paper_id long, label string")
    counts = coder.with_folds(rows, "paper_id", 5).groupBy("label", "fold").count().collect()
    for label in "xy":
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_scores_by_hand(spark):
    data = [("t", "m", 0, "a", "a"), ("t", "m", 0, "a", "b"), ("t", "m", 0, "b", "b"), ("t", "m", 1, "a", "a"), ("t", "m", 1, "a", "c")]
    df = spark.createDataFrame(data, "task string, model string, fold int, label string, predicted string")
    got = {r["fold"]: r for r in coder.fold_scores(df).collect()}
    assert math.isclose(got[0]["f1_macro"], (2 / 3 + 2 / 3) / 2) and math.isclose(got[0]["accuracy"], 2 / 3)
    assert math.isclose(got[1]["f1_macro"], (2 / 3 + 0) / 2) and got[1]["n"] == 2
    summary = coder.cv_summary(coder.fold_scores(df)).first()
    assert math.isclose(summary["f1_macro_std"], 1 / 6) and summary["cv_folds"] == 2


def test_features_match_the_relational_weights(spark):
    """The vectors the classifiers see carry the same numbers as the weights table."""
    from sedge.operators.terms import tfidf

    df = spark.createDataFrame([(0, "ab ab cd"), (1, "ab the cd ef"), (2, "ef xy")], "id long, t string")
    model = coder.fit_features(df, "t", stopwords=["the"])
    vocabulary = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    got = {}
    for r in model.transform(df).collect():
        got |= {(r["id"], vocabulary[i]): v for i, v in zip(r["_features"].indices, r["_features"].values)}
    want = {(r["id"], r["term"]): r["weight"] for r in tfidf(df, "id", "t", stopwords=["the"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_model_queries_run_the_whole_grids(spark, monkeypatch):
    from sedge.operators import coder as coders
    from sedge.operators import regress as regressors
    from sedge.plans import learning

    class Seen(Exception):
        pass

    def stop(*given, **named):
        raise Seen(named)

    for module, name in ((regressors, "train_models"), (coders, "evaluate_task"), (coders, "run_coding")):
        monkeypatch.setattr(module, name, stop)
    for query in (learning.regression_trees, learning.text_coder_cv, learning.coder_predictions):
        try:
            query(spark, "/root/testdata/sf0.001")
        except Seen as seen:
            assert not {"grids", "folds", "models", "cv", "trees"} & seen.args[0].keys()
        else:
            raise AssertionError("not called")
