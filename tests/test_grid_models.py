"""Moments against whole rows, trees on a grid against plain recursion, prefixes against separate fits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators import grid_trees as G
from sedge.operators import linear, regress
from sedge.operators.splitting import hash_split


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 12, 900), rng.integers(0, 5, 900), rng.normal(0, 1, 900)])
    y = 3.0 * (x[:, 0] > 6) + x[:, 1] ** 2 + 0.5 * x[:, 2] + rng.normal(0, 0.3, 900) + 1e6
    data = [(i, i % 5, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, fold int, a double, b double, c double, y double").cache()


def pandas_of(rows):
    frame = rows.orderBy("id").toPandas()
    return frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy(), frame["fold"].to_numpy()


def test_moments_answer_every_fold(rows):
    x, y, fold = pandas_of(rows)
    folds = linear.moments(rows, ["a", "b", "c", "y"], "fold")
    for f in range(5):
        rest, held = fold != f, fold == f
        m = linear.merged((v for k, v in folds.items() if k != f), 4)
        assert m.n == rest.sum() and np.allclose(m.products, np.cov(np.c_[x, y][rest].T, bias=True) * m.n)
        line = linear.least_squares(m)
        design = np.c_[np.ones(rest.sum()), x[rest]]
        want = np.linalg.lstsq(design, y[rest], rcond=None)[0]
        assert np.allclose([line.intercept, *line.weights], want)
        errors = y[held] - np.c_[np.ones(held.sum()), x[held]] @ want
        assert line.mean_squared_error(folds[f]) == pytest.approx(np.mean(errors**2), rel=1e-6)


@pytest.mark.parametrize(("alpha", "ratio"), [(0.01, 0.1), (0.5, 0.9), (3.0, 0.5)])
def test_elastic_net_is_optimal(rows, alpha, ratio):
    x, y, _ = pandas_of(rows)
    line = linear.elastic_net(linear.merged(linear.moments(rows, ["a", "b", "c", "y"], "fold").values(), 4), alpha, ratio)
    spread = x.std(0, ddof=1)
    z, w = (x - x.mean(0)) / spread, line.weights * spread
    left = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - ratio) * w
    for g, v in zip(left, w, strict=True):
        assert abs(g) <= alpha * ratio + 1e-6 and (v == 0 or g == pytest.approx(alpha * ratio * np.sign(v), abs=1e-6))


def test_odd_moments(spark):
    flat = spark.createDataFrame([(0, 1.0, 2.0, 5.0), (1, 1.0, 4.0, 9.0), (1, 1.0, 3.0, 7.0)], "fold int, a double, b double, y double")
    line = linear.least_squares(linear.merged(linear.moments(flat, ["a", "b", "y"], "fold").values(), 3))
    assert line.intercept + line.weights @ [1.0, 10.0] == pytest.approx(21.0)
    with pytest.raises(ValueError, match="lacks"):
        linear.moments(flat.withColumn("b", F.when(F.col("b") < 3, F.col("b"))), ["a", "b", "y"], "fold")
    assert linear.merged([], 2).n == 0


def plain_tree(bins, w, t, depth, least):
    out, floor = np.zeros(len(w)), G.TINY * max((t[w > 0] ** 2 / w[w > 0]).sum(), 1e-300)

    def walk(cells, depth):
        n, s, best, sides = w[cells].sum(), t[cells].sum(), floor, None
        for b in bins if depth and n >= least else []:
            for c in np.unique(b[cells]):
                left, right = cells[b[cells] <= c], cells[b[cells] > c]
                if w[left].sum() > 0 and w[right].sum() > 0:
                    gain = w[left].sum() * w[right].sum() / n * (t[left].sum() / w[left].sum() - t[right].sum() / w[right].sum()) ** 2
                    if gain > best * (1 + 1e-12):
                        best, sides = gain, (left, right)
        if sides is None:
            out[cells] = s / n
        else:
            walk(sides[0], depth - 1)
            walk(sides[1], depth - 1)

    walk(np.arange(len(w)), depth)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_one_deep_tree_gives_all_limits(seed):
    rng = np.random.default_rng(seed)
    bins = [b.reshape(-1) for b in np.indices(tuple(rng.integers(1, 7, rng.integers(1, 4))))]
    w = np.r_[1.0, rng.poisson(1.3, len(bins[0]) - 1)]
    t = np.where(w > 0, rng.integers(-5, 6, len(w)) * w + rng.normal(size=len(w)), 0.0)
    found = iter(G.grow(bins, G.orders(bins), w, t, 50, (2, 5), (1, 2, 3, 50)))
    for depth in (1, 2, 3, 50):
        for least in (2, 5):
            assert np.allclose(next(found), plain_tree(bins, w, t, depth, least))


def test_grid_of_values_and_quantiles(spark):
    df = spark.createDataFrame([(float(k % 7), float(k)) for k in range(2000)] + [(None, 1.0), (float("nan"), 2.0)], "a double, b double")
    grid = G.bins_of(df, ["a", "b"])
    assert grid.cuts[0] == (0.5, 1.5, 2.5, 3.5, 4.5, 5.5) and len(grid.cuts[1]) == 255 and grid.cells == 7 * 256
    cells = grid.with_cell(df)
    assert cells.filter("_cell is null").count() == 2 and cells.columns == ["a", "b", "_cell"]
    for r in cells.filter("_cell is not null").sample(0.05, seed=1).collect():
        assert r["_cell"] == sum(c <= r["a"] for c in grid.cuts[0]) * 256 + sum(c <= r["b"] for c in grid.cuts[1])
    assert G.bins_of(df, list("abcde")) is None


def test_boosting_prefixes_are_separate_fits(spark, rows):
    sums = G.cell_sums(rows, G.bins_of(rows, ["a", "b"]), "y", "fold")
    long = {"n_estimators": [4, 9], "learning_rate": [0.1, 0.5], "max_depth": [2]}
    errors, points, tables = G.search_boosting(spark, sums, long)
    x, y, fold = pandas_of(rows)
    bins = sums.grid.bins()
    cell = (x[:, 0] * 5 + x[:, 1]).astype(int)
    for k, p in enumerate(points):
        alone = G.search_boosting(spark, sums, {n: [v] for n, v in p.items()})
        assert alone[0][0] == pytest.approx(errors[k]) and np.allclose(alone[2][0], tables[k])

        def fit(of):
            predicted = np.zeros(60)
            n, t = np.bincount(cell[of], minlength=60), np.bincount(cell[of], y[of], 60)
            for r in range(p["n_estimators"]):
                predicted = predicted + (p["learning_rate"] if r else 1.0) * plain_tree(bins, n.astype(float), t - n * predicted, 2, 2)
            return predicted

        assert np.allclose(fit(fold >= 0), tables[k])
        assert np.mean([np.sqrt(np.mean((y - fit(fold != f)[cell])[fold == f] ** 2)) for f in range(5)]) == pytest.approx(errors[k])


def test_forest_prefixes_are_separate_fits(spark, rows):
    hashed = rows.withColumn("row", F.xxhash64("id"))
    sums = G.cell_sums(hashed, G.bins_of(hashed, ["a", "b"]), "y", "fold")
    grid = {"n_estimators": [3, 6], "max_depth": [None, 2], "min_samples_split": [2, 40]}
    errors, points, tables = G.search_forest(hashed, sums, "y", "fold", "row", grid)
    frame = hashed.orderBy("id").toPandas()
    y, fold, cell = frame["y"].to_numpy(), frame["fold"].to_numpy(), (frame["a"] * 5 + frame["b"]).to_numpy().astype(int)
    bins = sums.grid.bins()
    for k, p in enumerate(points):

        def fit(of):
            trees = []
            for tree in range(p["n_estimators"]):
                w = G.bag_weights(frame["row"].to_numpy(), tree)[of].astype(float)
                n, t = np.bincount(cell[of], w, 60), np.bincount(cell[of], w * (y[of] - sums.centre), 60)
                trees.append(plain_tree(bins, n, t, p["max_depth"] or 99, p["min_samples_split"]))
            return np.mean(trees, axis=0) + sums.centre

        assert np.allclose(fit(fold >= 0), tables[k])
        assert np.mean([np.sqrt(np.mean((y - fit(fold != f)[cell])[fold == f] ** 2)) for f in range(5)]) == pytest.approx(errors[k])


def test_bags():
    row = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    w = np.array([G.bag_weights(row, t) for t in range(20)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w).sum() - 20) < 5
    assert (w[3] == G.bag_weights(row, 3)).all()


def test_bag_weights_are_the_steps_of_a_poisson_number():
    row = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 300_000)
    x = (row.view(np.uint64) + np.uint64(8 * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    want = np.searchsorted(G._CHANCES, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")
    assert (G.bag_weights(row, 7) == want).all() and G.bag_weights(row, 7).dtype == np.uint8


def test_bag_sums_come_once_per_place(spark, monkeypatch):
    """However the rows lie and however many there are, a tree's sums are as many as its places; only a place too full for a task comes in parts."""
    rng = np.random.default_rng(4)
    at = np.r_[rng.integers(0, 40, 4000), np.full(6000, 7)]
    y, row = rng.normal(size=10_000), rng.integers(0, 1 << 52, 10_000)
    data = [(int(a), float(b), int(c)) for a, b, c in zip(at, y, row, strict=True)]
    rows = spark.createDataFrame(data, "at int, y double, row long").repartition(9)
    monkeypatch.setattr(G, "STRETCH", 64)
    counts = np.bincount(at, minlength=50).astype(float)
    parts = G.dealt(rows, counts, 500)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert parts.rdd.getNumPartitions() == 20 and max(sizes) < 1200
    n, t, times = np.zeros((3, 50)), np.zeros((3, 50)), np.zeros((3, 50))
    for r in parts.mapInArrow(G._bags(3), G.BAG).collect():
        cells, own_n, own_t = G._unpacked(r["at"], r["n"], r["t"])
        n[r["tree"], cells] += own_n
        t[r["tree"], cells] += own_t
        times[r["tree"], cells] += 1
    for tree in range(3):
        w = G.bag_weights(row, tree).astype(float)
        assert (n[tree] == np.bincount(at, w, 50)).all() and np.allclose(t[tree], np.bincount(at, w * y, 50))
    assert (np.delete(times, 7, axis=1) <= 1).all() and (times[:, 7] <= 20).all()


def test_cells_of_odd_values(spark):
    inf, tiny = float("inf"), 5e-324
    values = [-inf, -1.0, -0.0, 0.0, tiny, 2 * tiny, 1.0, inf]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "a double")
    grid = G.bins_of(df, ["a"])
    cuts = grid.cuts[0]
    assert np.isfinite(cuts).all() and list(cuts) == sorted(set(cuts))
    found = [(r["a"], r["_cell"]) for r in grid.with_cell(df).collect()]
    assert all(cell == sum(c <= a for c in cuts) for a, cell in found[:-2]) and [c for _, c in found[-2:]] == [None, None]
    ends = dict(found[:-2])
    assert ends[-inf] < ends[-1.0] and ends[1.0] < ends[inf]
    zero = G.Grid(("a",), ((0.0,),)).with_cell(df).filter("a = 0")
    assert [r["_cell"] for r in zero.collect()] == [1, 1]
    one = df.filter("a = 1")
    assert G.bins_of(one, ["a"]).with_cell(one).first()["_cell"] == 0


def test_an_id_may_be_a_feature(spark):
    df = hash_split(spark.createDataFrame([(i, float(i % 4), float(i // 50)) for i in range(200)], "id long, a double, y double"), ["id", "a"])
    grids = {"rf": {"n_estimators": [2], "max_depth": [3], "min_samples_split": [2]}}
    done = regress.train_models(df, ["id"], "y", ["id", "a"], enabled=["rf", "linreg"], grids=grids)
    assert done.best_name == "rf" and done.leaderboard.count() == 2


def test_more_features_than_a_grid_holds(spark):
    rng = np.random.default_rng(0)
    data = [(i, *map(float, rng.integers(0, 4, 5)), float(i % 3)) for i in range(120)]
    df = hash_split(spark.createDataFrame(data, "id long, a double, b double, c double, d double, e double, y double"), ["id"])
    grids = {"rf": {"n_estimators": [2], "max_depth": [3], "min_samples_split": [2]}, "gbr": {"n_estimators": [2], "learning_rate": [0.1], "max_depth": [2]}}
    done = regress.train_models(df, list("abcde"), "y", ["id"], enabled=["rf", "gbr"], grids=grids)
    assert {r["model"] for r in done.leaderboard.collect()} == {"rf", "gbr"} and "y_pred" in done.best_model.transform(df).columns
    assert json.loads(done.leaderboard.first()["best_params"])
