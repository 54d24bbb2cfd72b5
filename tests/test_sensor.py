"""Cleaning, elapsed time, splits, scaling, proxies and sweeps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions.formula import UnsafeFormula, compile_formula
from sedge.functions.lexicon import PROXY_ASSUMPTIONS
from sedge.operators import cleaning, diagnostics, ordering, proxies, quantiles, scaling, splitting, sweep
from sedge.operators.elapsed import elapsed_seconds


def clock_table(spark, readings):
    return spark.createDataFrame(list(enumerate(readings)), "seq long, time string")


def elapsed_of(spark, readings, **kw):
    out = elapsed_seconds(clock_table(spark, readings), "time", ["seq"], **kw)
    return [r["time_s"] for r in out.orderBy("seq").collect()]


def test_elapsed_reset_takes_the_median_step(spark):
    assert elapsed_of(spark, ["00:00:00", "00:00:15", "00:00:30", "00:00:00", "00:00:15"]) == [0, 15, 30, 45, 60]


def test_elapsed_missing_reading_breaks_two_steps(spark):
    assert elapsed_of(spark, ["00:00:00", "00:00:10", "x", "00:00:30", "00:00:42"]) == [0, 10, 21, 32, 44]


def test_elapsed_without_positive_steps_uses_the_default(spark):
    assert elapsed_of(spark, ["00:00:09", "00:00:05", "00:00:01"]) == [0, 15, 30]
    assert elapsed_of(spark, []) == []


def test_elapsed_garbage_raises(spark):
    with pytest.raises(ValueError):
        elapsed_of(spark, ["x", "y", "z"])


def brute_elapsed(readings):
    """Plain reference for one series of seconds or None."""
    steps = [None] + [b - a if a is not None and b is not None and b > a else None for a, b in zip(readings, readings[1:])]
    good = sorted(s for s in steps if s is not None)
    usual = float(np.median(good)) if good else 15.0
    total, out = 0.0, []
    for i, s in enumerate(steps):
        total += 0.0 if i == 0 else (s if s is not None else usual)
        out.append(total)
    return out


@pytest.mark.parametrize("keys", [[], ["unit"]])
@pytest.mark.parametrize("ranges", [1, 8, 30])
def test_elapsed_in_ranges_equals_brute_force(spark, keys, ranges):
    """A hot key with a third of the rows, NULL keys, gaps and resets, cut into many ranges."""
    rng = random.Random(5)
    rows, series = [], {}
    for seq in range(900):
        unit = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None, "c"])
        t = None if rng.random() < 0.1 else rng.randrange(0, 80000)
        text = "bad" if t is None else f"{t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}"
        rows.append((seq, unit, text))
        series.setdefault(unit if keys else 0, []).append((seq, t))
    want = {}
    for members in series.values():
        for (seq, _), value in zip(members, brute_elapsed([t for _, t in members])):
            want[seq] = value
    df = spark.createDataFrame(rows, "seq long, unit string, time string").repartition(7)
    out = elapsed_seconds(df, "time", ["seq"], keys, ranges=ranges)
    got = {r["seq"]: r["time_s"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_positions_with_ties_and_ranges(spark):
    rows = [(i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    got = ordering.positions(df, ["v", "id"], "pos", ranges=12).collect()
    want = {i: p for p, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["id"]: r["pos"] for r in got} == want


def test_order_cuts_are_few_and_sorted(spark):
    df = spark.range(10_000)
    cuts = ordering.order_cuts(df, ["id"], 10)
    assert 5 <= len(cuts) <= 9 and cuts == sorted(cuts)
    sizes = [r["count"] for r in ordering.with_range(df, ["id"], cuts).groupBy("_range").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 3000


def test_first_rows(spark, rows):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, None), (2, 1, "c"), (None, 3, "d")], "k int, o int, v string")
    assert rows(ordering.first_rows(df, ["k"], ["o"])) == [(1, 2, None), (2, 1, "c"), (None, 3, "d")]


def test_quantiles_in_memory_and_bracketed_agree(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=4000), np.full(2500, 1.25), rng.exponential(1e6, 1000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").union(
        spark.createDataFrame([(None,), (float("nan"),)], "x double")
    )
    at = [0.0, 0.1, 0.5, 0.8, 0.9, 1.0]
    want = np.quantile(values, at)
    assert np.allclose(quantiles.quantiles(df, ["x"], at)["x"], want)
    assert np.allclose(quantiles.quantiles(df, ["x"], at, inside=300)["x"], want)


def test_grouped_quantile_by_ranges(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else "k", float(rng.randrange(50))) for i in range(600)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r["m"] for r in quantiles.grouped_quantile(df, "v", 0.5, ["k"], "m", ranges=5).collect()}
    assert got == {k: float(np.median([v for x, v in data if x == k])) for k in ("hot", "k")}


def raw_table(spark, n=200):
    rng = np.random.default_rng(0)
    data = [
        (i, f"00:{i // 60:02d}:{i % 60:02d}", f"{rng.uniform(20, 250):.2f}".replace(".", ","), str(rng.uniform(0, 5)),
         None if i == 0 else str(rng.uniform(0, 40)))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id long, time string, temperature string, Stiring string, pressure string")


def test_prepare(spark):
    done = cleaning.prepare(raw_table(spark), ["temperature", "Stiring"], "pressure", ["id"], clock="time", order=["id"])
    assert done.features == ["time_s", "temperature", "Stiring"]
    assert tuple(done.report.first()) == (200, 199, 1)
    sizes = {r["split"]: r["rows"] for r in splitting.split_sizes(done.df).collect()}
    assert sum(sizes.values()) == 199 and set(sizes) == {"train", "test", "validation"}
    assert cleaning.prepared_problems(done.df, done.features, done.target).count() == 0
    # The dropped first row still counts as a step.
    assert done.df.agg(F.min("time_s")).first()[0] == 1.0
    with pytest.raises(ValueError):
        cleaning.prepare(raw_table(spark, 5), ["not_there"], "pressure", ["id"])


def test_exact_split_sizes(spark):
    df = spark.range(9225)
    for limit in (10_000, 500):
        split = splitting.hash_split(df, ["id"], exact=True, inside=limit)
        sizes = {r[0]: r[1] for r in splitting.split_sizes(split).collect()}
        assert sizes == {"train": 5904, "test": 1476, "validation": 1845}


def test_split_is_the_same_under_any_partitioning(spark, rows):
    df = spark.range(500)
    once = rows(splitting.hash_split(df, ["id"]))
    assert rows(splitting.hash_split(df.repartition(13), ["id"])) == once
    assert rows(splitting.hash_split(df, ["id"], seed=7)) != once


def test_raw_problems(spark):
    empty = spark.createDataFrame([], "a string")
    found = {r["rule"]: r["detail"] for r in cleaning.raw_problems(empty, ["a", "missing"], 5).collect()}
    assert found["too_few_rows"] == "Too few rows: 0 < 5." and "missing" in found["missing_column"]
    assert "all_empty" in found
    twice = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "a")
    assert [r["rule"] for r in cleaning.raw_problems(twice).collect()] == ["duplicate_columns"]


def test_prepared_problems(spark):
    df = spark.createDataFrame([("train", 1.0), ("test", None)], "split string, y double")
    assert {r["detail"] for r in cleaning.prepared_problems(df, [], "y").collect()} == {
        "Empty val split.", "Target contains NaN after cleaning.", "No feature columns selected."
    }


def test_minmax_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, 5.0, None), (float("nan"), 5.0, None), (2.0, 5.0, None)],
                               "a double, b double, c double")
    out = scaling.minmax(df, ["a", "b", "c"]).select("a_n", "b_n", "c_n").collect()
    assert [r["a_n"] for r in out] == [0.0, 1.0, None, None, 0.5]
    assert [r["b_n"] for r in out] == [0.0] * 5 and [r["c_n"] for r in out] == [0.0] * 5


def test_minmax_per_group_with_null_key(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 2.0), (None, 4.0)], "k string, a double")
    assert sorted(r["a_n"] for r in scaling.minmax(df, ["a"], ["k"]).collect()) == [0.0, 0.0, 1.0, 1.0]


def scored_table(spark, names=("time_s", "Temperature (°C)", "Stiring"), n=60, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, float(rng.uniform(0, 1000)), float(rng.uniform(20, 250)), float(rng.uniform(0, 5)), float(rng.uniform(0, 40))) for i in range(n)]
    return spark.createDataFrame(data, f"id long, `{names[0]}` double, `{names[1]}` double, `{names[2]}` double, y_pred double"), np.array(data)


def scale(x):
    return (x - x.min()) / (x.max() - x.min())


def test_weighted_proxies_find_unit_columns(spark):
    df, data = scored_table(spark)
    assert proxies.fixed_drivers(df.columns) == {"time": "time_s", "temperature": "Temperature (°C)", "stirring": "Stiring"}
    out = proxies.weighted_proxies(df).orderBy("id").toPandas()
    e = 0.4 * scale(data[:, 1]) + 0.4 * scale(data[:, 2]) + 0.2 * scale(data[:, 3])
    assert np.allclose(out["energy_proxy"], e)
    assert np.allclose(out["co2_proxy"], 0.7 * e + 0.3 * scale(data[:, 4]))
    assert np.allclose(out["mci_proxy"], np.clip(1 - 0.6 * e - 0.4 * scale(data[:, 4]), 0, 1))


def test_weighted_proxies_without_drivers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "y_pred double")
    assert [r["energy_proxy"] for r in proxies.weighted_proxies(df).collect()] == [0.0, 0.0]


def test_pca_matches_svd(spark):
    df, data = scored_table(spark)
    x = data[:, 1:4]
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    axis = vt[0] * np.sign(vt[0][np.argmax(np.abs(vt[0]))])
    fit = proxies.energy_axes(df, ["time_s", "Temperature (°C)", "Stiring"]).first()
    assert np.allclose(fit["loadings"], axis) and np.isclose(fit["explained"], s[0] ** 2 / (s**2).sum())
    out = proxies.pca_proxies(df).orderBy("id").toPandas()
    assert np.allclose(out["energy_pca_proxy"], scale(z @ axis))
    assert out["mci_pca_proxy"].between(0, 1).all()


def test_pca_two_columns_and_order(spark):
    df, data = scored_table(spark)
    a = proxies.energy_axes(df, ["time_s", "Stiring"]).first()["loadings"]
    b = proxies.energy_axes(df, ["Stiring", "time_s"]).first()["loadings"]
    assert a[0] > 0 and b[0] > 0 and np.allclose(np.abs(a), np.sqrt(0.5))


def test_pca_modes(spark):
    assert proxies.pca_mode(["time_s", "y_pred"]) == ("single_column_fallback", ["time_s"])
    assert proxies.pca_mode(["y_pred"])[0] == "no_columns_fallback"
    one = spark.createDataFrame([(0.0, 1.0), (2.0, 5.0), (1.0, 3.0)], "time_s double, y_pred double")
    assert [r["energy_pca_proxy"] for r in proxies.pca_proxies(one).collect()] == [0.0, 1.0, 0.5]
    none = spark.createDataFrame([(1.0,), (2.0,)], "y_pred double")
    assert [r["energy_pca_proxy"] for r in proxies.pca_proxies(none).collect()] == [0.0, 0.0]


def test_pca_constant_column_and_one_row(spark):
    df = spark.createDataFrame([(1.0, 7.0, 1.0), (2.0, 7.0, 2.0), (4.0, 7.0, 3.0)], "time_s double, temperature double, y_pred double")
    got = [r["energy_pca_proxy"] for r in proxies.pca_proxies(df).collect()]
    assert np.allclose(got, [0, 1 / 3, 1])
    assert proxies.pca_proxies(df.limit(1)).first()["energy_pca_proxy"] == 0.0


def test_assumed_proxies_scale_the_raw_sum(spark):
    df, data = scored_table(spark)
    out = proxies.assumed_proxies(df).orderBy("id").toPandas()
    e = scale(0.4 * data[:, 1] + 0.4 * data[:, 2] + 0.2 * data[:, 3])
    assert np.allclose(out["energy_assumed"], e) and np.allclose(out["co2_assumed"], 0.7 * e + 0.3 * scale(data[:, 4]))


@pytest.mark.parametrize(
    "change",
    [{"energy": {"weights": {}}}, {"energy": {"method": "x", "weights": {"time": 1}}}, {"energy": {"weights": {"wind": 1}}},
     {"energy": {"weights": {"time": 1}, "normalize": "z"}}, {"metrics": {}}, {"metrics": {"a": 1}}, {"drivers": {"time": "time_s"}}],
)
def test_assumed_proxies_reject_bad_configs(spark, change):
    df, _ = scored_table(spark, n=2)
    with pytest.raises(ValueError):
        proxies.assumed_proxies(df, {**PROXY_ASSUMPTIONS, **change})


@pytest.mark.parametrize(
    "bad", ["__import__('os')", "open('x')", "import os", "eval('1')", "energy.real", "[1]", "energy if 1 else 2", "unknown + 1",
            "clip(energy)", "np.load(1)", "lambda: 1", "True", "'a'", "energy; 1", ""]
)
def test_unsafe_formulas(spark, bad):
    with pytest.raises(UnsafeFormula):
        compile_formula(bad, {"energy": F.lit(1.0)})


def test_formula_values_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 4.0), (None, 4.0), (0.0, -1.0)], "a double, b double")
    get = lambda f: [r[0] for r in df.select(compile_formula(f, {"a": F.col("a"), "b": F.col("b")})).collect()]
    assert get("min(a, b)") == [2.0, None, -1.0]
    assert get("np.clip(b / a, 0, 1.5)") == [1.5, None, None]
    assert get("sqrt(b) - -a ** 2") == [6.0, None, None]
    assert get("(a >= b) * 3 + abs(b)") == [4.0, None, 4.0]


def test_eco_efficiency(spark):
    df = spark.createDataFrame([(10.0, 0.1), (10.0, 0.9), (1.0, 0.9)], "y_pred double, co2_proxy double")
    out = [r["eco_eff_proxy"] for r in proxies.eco_efficiency(df, "co2_proxy").collect()]
    assert out[0] == 1.0 and out[2] == 0.0 and 0 < out[1] < 1
    with pytest.raises(KeyError):
        proxies.eco_efficiency(df, "nope")


def test_scenario_range_fallbacks(spark):
    df = spark.createDataFrame([(float(i), 5.0, None) for i in range(10)], "a double, b double, c double")
    got = sweep.scenario_ranges(df, ["a", "b", "c"])
    assert np.allclose(got["a"], (0.9, 8.1)) and got["b"] == (0.0, 1.0) and got["c"] == (0.0, 1.0)


def test_linspace_ends():
    assert sweep.linspace(0.1, 0.7, 7)[-1] == 0.7 and sweep.linspace(2, 9, 1) == [2.0]
    assert np.allclose(sweep.linspace(0, 1, 25), np.linspace(0, 1, 25))


def test_sweep_end_to_end(spark):
    rng = np.random.default_rng(0)
    base = spark.createDataFrame(
        [(float(rng.uniform(0, 1000)), float(rng.uniform(20, 250)), float(rng.uniform(0, 5))) for _ in range(100)],
        "time_s double, temperature double, Stiring double",
    )
    scorer = lambda df: df.withColumn("y_pred", F.lit(0.01) * F.col("temperature") + F.lit(0.5) * F.col("Stiring"))
    out = sweep.run_sweep(scorer, base, base.limit(1), ["temperature", "Stiring"], 12, PROXY_ASSUMPTIONS).toPandas()
    assert len(out) == 24 and set(out["_var"]) == {"temperature", "Stiring"}
    assert {"co2_v1", "mci_v1", "co2_pca", "mci_pca", "co2_assumed", "mci_assumed"} <= set(out.columns)
    assert out[out["_var"] == "temperature"].sort_values("_val")["y_pred"].is_monotonic_increasing
    with pytest.raises(ValueError):
        sweep.run_sweep(scorer, base.select(F.col("time_s").alias("unrelated")), base)


def test_regression_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 4.0, 3.0), ("b", 3.0, 3.0), ("b", 3.0, 3.0), ("c", 3.0, 2.0)],
                               "k string, y double, p double")
    got = {r["k"]: (r["rmse"], r["r2"]) for r in diagnostics.regression_metrics(df, "y", "p", ["k"]).collect()}
    assert np.allclose(got["a"], (math.sqrt(1.25 / 3), 1 - 1.25 / (14 / 3)))
    assert got["b"] == (0.0, 1.0) and got["c"] == (1.0, 0.0)


def test_histogram_closes_the_last_bin(spark):
    values = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["bin"]: r["n"] for r in diagnostics.histogram(df, "x", 4).collect()}
    assert [got.get(i, 0) for i in range(4)] == np.histogram(values, 4)[0].tolist()
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert diagnostics.histogram(flat, "x", 4).first()["n"] == 2


def test_correlations_and_shift(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(50, 2))
    df = spark.createDataFrame([(float(a), float(b), "test" if i % 2 else "validation") for i, (a, b) in enumerate(data)], "a double, b double, split string")
    assert np.isclose(diagnostics.correlations(df, ["a", "b"]).first()["corr"], np.corrcoef(data.T)[0, 1])
    got = {r["metric"]: r["value"] for r in diagnostics.distribution_shift(df, ["a"]).collect()}
    test, val = data[1::2, 0], data[::2, 0]
    assert np.isclose(got["a_mean_diff"], test.mean() - val.mean())
    assert np.isclose(got["a_std_ratio"], val.std(ddof=1) / (test.std(ddof=1) + 1e-9))


def test_many_groups_take_the_join(spark, rows, monkeypatch):
    """Beyond the limit on fetched groups the statistics are joined, with the same result."""
    rng = random.Random(4)
    data = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), float(i % 17), rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame(data, "k string, time_s double, temperature double, y_pred double")
    few = rows(proxies.all_proxies(df, config=PROXY_ASSUMPTIONS, keys=["k"]))
    monkeypatch.setattr(ordering, "MAX_LOCAL_GROUPS", 2)
    many = rows(proxies.all_proxies(df, config=PROXY_ASSUMPTIONS, keys=["k"]))
    assert [r[0] for r in few] == [r[0] for r in many]
    assert all(np.allclose(a[1:], b[1:]) for a, b in zip(few, many))


def test_all_proxies_equal_the_single_ones(spark):
    df, _ = scored_table(spark)
    together = proxies.all_proxies(df, config=PROXY_ASSUMPTIONS).orderBy("id").toPandas()
    for one in (proxies.weighted_proxies(df), proxies.pca_proxies(df), proxies.assumed_proxies(df)):
        alone = one.orderBy("id").toPandas()
        for c in [c for c in alone.columns if c.endswith(("proxy", "assumed"))]:
            assert np.allclose(alone[c], together[c])


def test_one_nan_is_one_gap(spark):
    from sedge.operators import diagnostics, scaling

    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (nan, 9.0), (5.0, nan)], "x double, y double")
    bins = {r["bin"]: (r["left_edge"], r["n"]) for r in diagnostics.histogram(df, "x", 2).collect()}
    assert bins == {0: (1.0, 2), 1: (3.0, 2)}
    z = [r["x_z"] for r in scaling.standardize(df, ["x"]).collect()]
    assert sum(v is None for v in z) == 1 and abs(sum(v for v in z if v is not None)) < 1e-9
    fit = diagnostics.regression_metrics(df, "x", "y").first()
    assert (fit["rmse"], fit["r2"]) == (0.0, 1.0)
    assert abs(diagnostics.correlations(df, ["x", "y"]).first()["corr"] - 1) < 1e-12
