"""Energy, CO2 and circularity proxies.

Each score needs the bounds of its inputs first and then one projection. With
``keys`` (a split, a plant) the bounds are taken per group.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sedge.functions.columns import (
    PCA_NAMES,
    STIRRING_NAMES,
    TEMPERATURE_NAMES,
    TIME_NAMES,
    match_columns,
    pick_column,
)
from sedge.functions.formula import compile_formula
from sedge.functions.lexicon import PROXY_ASSUMPTIONS
from sedge.functions.numbers import clip, finite_or_null
from sedge.operators.ordering import attach
from sedge.operators.scaling import Bounds, by_bounds, fixed_bounds, with_bounds

WEIGHTS = {"time": 0.40, "temperature": 0.40, "stirring": 0.20}


def fixed_drivers(columns: Sequence[str]) -> dict[str, str | None]:
    """Columns the weighted score uses as time, temperature and stirring."""
    return {
        "time": pick_column(columns, TIME_NAMES),
        "temperature": pick_column(columns, TEMPERATURE_NAMES),
        "stirring": pick_column(columns, STIRRING_NAMES),
    }


def _co2(energy: Column, output: Column) -> Column:
    return F.lit(0.7) * energy + F.lit(0.3) * output


def _circularity(energy: Column, output: Column) -> Column:
    return clip(F.lit(1.0) - (F.lit(0.6) * energy + F.lit(0.4) * output), 0.0, 1.0)


def _inputs(df: DataFrame, y_pred: str, drivers: Mapping[str, str | None]) -> dict[str, Column]:
    found = {role: F.col(f"`{c}`") for role, c in drivers.items() if c}
    return {**found, "y_pred": F.col(f"`{y_pred}`")}


def _scores(df: DataFrame, energy: Column, names: tuple[str, str, str]) -> DataFrame:
    """Energy, CO2 and circularity columns; ``_y`` holds the scaled output."""
    e = F.col(names[0])
    return df.withColumn(names[0], energy).withColumns(
        {names[1]: _co2(e, F.col("_y")), names[2]: _circularity(e, F.col("_y"))}
    )


def _weighted(df: DataFrame, inputs: Mapping[str, Column], weights: Mapping[str, float]) -> DataFrame:
    energy = F.lit(0.0)
    for role in ("time", "temperature", "stirring"):
        if role in inputs:
            energy = energy + F.lit(float(weights[role])) * by_bounds(role, inputs[role])
    return _scores(df, energy, ("energy_proxy", "co2_proxy", "mci_proxy"))


def _with_output(df: DataFrame, y_pred: str) -> DataFrame:
    return df.withColumn("_y", by_bounds("y_pred", F.col(f"`{y_pred}`")))


def weighted_proxies(
    df: DataFrame,
    y_pred: str = "y_pred",
    weights: Mapping[str, float] = WEIGHTS,
    keys: Sequence[str] = (),
    bounds: Bounds | None = None,
    drivers: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Add ``energy_proxy``, ``co2_proxy``, ``mci_proxy``; a driver without column counts as 0.

    ``bounds`` freezes the scaling to known ranges, for rows that arrive later.
    """
    inputs = _inputs(df, y_pred, drivers or fixed_drivers(df.columns))
    bounded = fixed_bounds(df, bounds) if bounds is not None else with_bounds(df, inputs, keys)
    return _weighted(_with_output(bounded, y_pred), inputs, weights).drop("_bounds", "_y")


def training_bounds(
    df: DataFrame, y_pred: str = "y_pred", drivers: Mapping[str, str | None] | None = None
) -> dict[str, tuple[float, float]]:
    """Bounds of a training table as numbers, to score a stream with."""
    inputs = _inputs(df, y_pred, drivers or fixed_drivers(df.columns))
    row = df.agg(
        *[F.min(finite_or_null(x)).alias(f"{n}_lo") for n, x in inputs.items()],
        *[F.max(finite_or_null(x)).alias(f"{n}_hi") for n, x in inputs.items()],
    ).first()
    return {n: (row[f"{n}_lo"], row[f"{n}_hi"]) for n in inputs}


def energy_axes(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """First principal axis of the standardised columns, one row per group.

    One aggregate gives the moments; each group's tiny eigenproblem is solved
    where its moments are. The sign of an axis is arbitrary in theory: here the
    loading largest in magnitude is positive, the first of equal ones.
    """
    k = len(columns)
    x = [F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(0.0)) for c in columns]
    moments = df.groupBy(*keys).agg(
        F.array(*[F.avg(v) for v in x]).alias("centre"),
        F.array(*[F.covar_pop(x[i], x[j]) for i in range(k) for j in range(k)]).alias("cov"),
    )
    fields = [moments.schema[key] for key in keys]
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [
            *fields,
            T.StructField("loadings", numbers),
            T.StructField("explained", T.DoubleType()),
            T.StructField("centre", numbers),
            T.StructField("spread", numbers),
        ]
    )

    def solve(batches):
        for pdf in batches:
            n = len(pdf)
            cov = np.array([[v or 0.0 for v in flat] for flat in pdf["cov"]], dtype=float).reshape(n, k, k)
            spread = np.sqrt(np.clip(np.diagonal(cov, axis1=1, axis2=2), 0.0, None))
            spread = np.where(spread == 0, 1.0, spread)
            # All groups of a batch at once.
            values, vectors = np.linalg.eigh(cov / (spread[:, :, None] * spread[:, None, :]))
            axis, total = vectors[:, :, -1], values.sum(1)
            size = np.abs(axis)
            lead = (size >= size.max(1, keepdims=True) - 1e-9).argmax(1)
            axis = np.where(axis[np.arange(n), lead] < 0, -1.0, 1.0)[:, None] * axis
            out = {
                "loadings": axis.tolist(),
                "explained": [float(v[-1] / t) if t else None for v, t in zip(values, total)],
                "spread": spread.tolist(),
            }
            yield pdf.drop(columns="cov").assign(**out)[[f.name for f in schema.fields]]

    return moments.mapInPandas(solve, schema)


def _along_axis(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add ``_axis``: the row's score on the first axis of its group."""
    axes = energy_axes(df, columns, keys)
    fit = F.struct("loadings", "centre", "spread").alias("_fit")
    if keys:
        out = attach(df, axes.select(*keys, fit), keys)
    else:
        out = df.withColumn("_fit", axes.select(fit).scalar())
    score = F.lit(0.0)
    for i, c in enumerate(columns):
        x = F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(0.0))
        centred = (x - F.col("_fit.centre")[i]) / F.col("_fit.spread")[i]
        score = score + F.col("_fit.loadings")[i] * centred
    return out.withColumn("_axis", score).drop("_fit")


def pca_mode(columns: Sequence[str], candidates: Iterable[str] = PCA_NAMES) -> tuple[str, list[str]]:
    """How :func:`pca_proxies` will treat a table with these columns, and which it uses."""
    used = match_columns(columns, candidates)
    modes = {0: "no_columns_fallback", 1: "single_column_fallback"}
    return modes.get(len(used), "pca"), used


def _with_axis(df: DataFrame, used: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add ``_axis``: the score on the first axis, the only column itself, or 0 without any."""
    if len(used) > 1:
        return _along_axis(df, used, keys)
    only = F.coalesce(finite_or_null(F.col(f"`{used[0]}`")), F.lit(0.0)) if used else F.lit(0.0)
    return df.withColumn("_axis", only)


PCA_SCORES = ("energy_pca_proxy", "co2_pca_proxy", "mci_pca_proxy")


def pca_proxies(
    df: DataFrame,
    y_pred: str = "y_pred",
    candidates: Iterable[str] = PCA_NAMES,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``energy_pca_proxy``, ``co2_pca_proxy``, ``mci_pca_proxy``.

    One driver alone is scaled directly; without any, energy is 0. NULL drivers count as 0.
    """
    scored = _with_axis(df, pca_mode(df.columns, candidates)[1], keys)
    inputs = {"axis": F.col("_axis"), "y_pred": F.col(f"`{y_pred}`")}
    out = _with_output(with_bounds(scored, inputs, keys), y_pred)
    return _scores(out, by_bounds("axis", inputs["axis"]), PCA_SCORES).drop("_bounds", "_y", "_axis")


def _checked(config: Mapping) -> Mapping:
    """The config, or an error that says what is wrong with it."""
    drivers, energy, metrics = (config.get(k, {}) for k in ("drivers", "energy", "metrics"))
    for name, names in drivers.items():
        if not isinstance(names, list):
            raise ValueError(f"drivers.{name} must be a list of column candidates")
    if (method := energy.get("method", "weighted_sum")) != "weighted_sum":
        raise ValueError(f"unsupported energy.method {method!r}")
    if (normalize := energy.get("normalize", "minmax")) not in ("minmax", "none"):
        raise ValueError(f"unsupported energy.normalize {normalize!r}")
    if not energy.get("weights"):
        raise ValueError("energy.weights is missing or empty")
    if unknown := [k for k in energy["weights"] if k not in drivers]:
        raise ValueError(f"energy.weights names unknown drivers {unknown}")
    if not metrics or not all(isinstance(f, str) for f in metrics.values()):
        raise ValueError("metrics must map names to formulas")
    return config


def _raw_drivers(columns: Sequence[str], config: Mapping) -> tuple[dict[str, Column], Column]:
    """Driver values, with 0 for what is missing, and their weighted sum."""
    picked = {name: pick_column(columns, names) for name, names in config["drivers"].items()}
    values = {
        name: F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(0.0)) if c else F.lit(0.0)
        for name, c in picked.items()
    }
    raw = F.lit(0.0)
    for name, weight in config["energy"]["weights"].items():
        raw = raw + F.lit(float(weight)) * values[name]
    return values, raw


def _assumed(df: DataFrame, config: Mapping, y_pred: str, values: Mapping[str, Column]) -> DataFrame:
    """Energy from ``_raw`` and the config's formulas."""
    scale = config["energy"].get("normalize", "minmax") == "minmax"
    out = df.withColumn("energy_assumed", by_bounds("raw", F.col("_raw")) if scale else F.col("_raw"))
    inputs = {
        "energy": F.col("energy_assumed"),
        "y_pred": finite_or_null(F.col(f"`{y_pred}`")),
        "y_pred_n": F.col("_y"),
        **values,
    }
    return out.withColumns({f"{n}_assumed": compile_formula(f, inputs) for n, f in config["metrics"].items()})


def assumed_proxies(
    df: DataFrame,
    config: Mapping = PROXY_ASSUMPTIONS,
    y_pred: str = "y_pred",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``energy_assumed`` and one ``<metric>_assumed`` per formula of the config.

    Unlike :func:`weighted_proxies` the weights apply to raw driver values and
    the sum is scaled.
    """
    values, raw = _raw_drivers(df.columns, _checked(config))
    inputs = {"raw": F.col("_raw"), "y_pred": F.col(f"`{y_pred}`")}
    out = _with_output(with_bounds(df.withColumn("_raw", raw), inputs, keys), y_pred)
    return _assumed(out, config, y_pred, values).drop("_bounds", "_raw", "_y")


def all_proxies(
    df: DataFrame, y_pred: str = "y_pred", config: Mapping | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The scores of every method; the assumed ones only with a config.

    One pass for the axis, one for all bounds, one for the scores.
    """
    inputs = _inputs(df, y_pred, fixed_drivers(df.columns))
    out = _with_axis(df, pca_mode(df.columns)[1], keys)
    bounded = {**inputs, "axis": F.col("_axis")}
    if config is not None:
        values, raw = _raw_drivers(df.columns, _checked(config))
        out, bounded = out.withColumn("_raw", raw), {**bounded, "raw": F.col("_raw")}
    out = _with_output(with_bounds(out, bounded, keys), y_pred)
    out = _scores(_weighted(out, inputs, WEIGHTS), by_bounds("axis", F.col("_axis")), PCA_SCORES)
    if config is not None:
        out = _assumed(out, config, y_pred, values)
    return out.drop("_bounds", "_y", "_axis", "_raw")


def eco_efficiency(
    df: DataFrame, burden: str, y_pred: str = "y_pred", eps: float = 1e-6, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``eco_eff_proxy``: scaled output per unit of burden, scaled again."""
    if burden not in df.columns:
        raise KeyError(f"no burden column {burden!r} in {df.columns}")
    y = F.col(f"`{y_pred}`")
    once = with_bounds(df, {"y_pred": y}, keys)
    ratio = by_bounds("y_pred", y) / (F.abs(finite_or_null(F.col(f"`{burden}`"))) + F.lit(eps))
    raw = once.withColumn("_eco", ratio).drop("_bounds")
    twice = with_bounds(raw, {"eco": F.col("_eco")}, keys)
    return twice.withColumn("eco_eff_proxy", by_bounds("eco", F.col("_eco"))).drop("_bounds", "_eco")


def method_comparison(df: DataFrame, y_pred: str = "y_pred", split: str = "split", config: Mapping = PROXY_ASSUMPTIONS) -> DataFrame:
    """Scores of all three methods side by side, each scaled within its split."""
    scored = all_proxies(df, y_pred, config, [split])
    return scored.select(
        *[c for c in df.columns if c not in (y_pred, split)],
        F.col(f"`{y_pred}`").alias("y_pred"),
        F.col("co2_proxy").alias("co2_v1"),
        F.col("co2_pca_proxy").alias("co2_pca"),
        "co2_assumed",
        F.col("mci_proxy").alias("mci_v1"),
        F.col("mci_pca_proxy").alias("mci_pca"),
        "mci_assumed",
        F.col(f"`{split}`").alias("split"),
    )
