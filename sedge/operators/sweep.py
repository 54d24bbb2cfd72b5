"""One-way what-if sweeps around one or many baseline rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, functions as F

from sedge.functions.columns import scenario_variables
from sedge.operators.proxies import all_proxies
from sedge.operators.quantiles import quantiles

Scorer = Transformer | Callable[[DataFrame], DataFrame]


def _degenerate(low: float | None, high: float | None) -> bool:
    return low is None or high is None or not abs(high - low) >= 1e-12 or abs(high - low) == float("inf")


def scenario_ranges(
    df: DataFrame, variables: Sequence[str], low: float = 0.10, high: float = 0.90
) -> dict[str, tuple[float, float]]:
    """Quantile range per variable; min and max where it is flat, then (0, 1)."""
    found = quantiles(df, variables, [low, high, 0.0, 1.0])
    out = {}
    for v, (q_low, q_high, smallest, largest) in found.items():
        pair = (smallest, largest) if _degenerate(q_low, q_high) else (q_low, q_high)
        out[v] = (0.0, 1.0) if _degenerate(*pair) else pair
    return out


def range_table(df: DataFrame, variables: Sequence[str], low: float = 0.10, high: float = 0.90) -> DataFrame:
    """The ranges as a table ``(var, lo, hi)``, one row per variable."""
    rows = [(v, *pair) for v, pair in scenario_ranges(df, variables, low, high).items()]
    return df.sparkSession.createDataFrame(rows, "var string, lo double, hi double")


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` evenly spaced values, both ends included."""
    if n == 1:
        return [float(low)]
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [float(high)]


def build_grids(ranges: Mapping[str, tuple[float, float]], points: int = 25) -> dict[str, list[float]]:
    return {v: linspace(*pair, points) for v, pair in ranges.items()}


def one_way(baselines: DataFrame, grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """Each baseline row once per variable and grid value, with only that variable replaced."""
    steps = [
        F.struct(F.lit(v).alias("var"), F.lit(float(x)).alias("val"))
        for v, values in grids.items()
        for x in values
    ]
    swept = baselines.select("*", F.explode(F.array(*steps)).alias("_step"))
    moved = {
        v: F.when(F.col("_step.var") == v, F.col("_step.val")).otherwise(F.col(f"`{v}`").cast("double"))
        for v in grids
    }
    return swept.withColumns({**moved, "_var": F.col("_step.var"), "_val": F.col("_step.val")}).drop("_step")


def predict(scorer: Scorer, df: DataFrame) -> DataFrame:
    """Apply a fitted model (its ``prediction`` becomes ``y_pred``) or a DataFrame function."""
    if not isinstance(scorer, Transformer):
        return scorer(df)
    out = scorer.transform(df)
    return out if "y_pred" in out.columns else out.withColumnRenamed("prediction", "y_pred")


def run_sweep(
    scorer: Scorer,
    base: DataFrame,
    baselines: DataFrame,
    variables: Sequence[str] | None = None,
    points: int = 25,
    config: Mapping | None = None,
    ids: Sequence[str] = (),
) -> DataFrame:
    """Sweep, predict and score.

    Ranges come from ``base``. The scores are scaled over the whole sweep, all
    variables together, per baseline when ``ids`` name it.
    """
    variables = list(variables) if variables is not None else scenario_variables(base.columns)
    if not variables:
        raise ValueError("no scenario variables found or given")
    grids = build_grids(scenario_ranges(base, variables), points)
    scored = predict(scorer, one_way(baselines, grids))
    scored = scored.select(*ids, *[c for c in [*base.columns, "_var", "_val", "y_pred"] if c not in ids])
    scored = all_proxies(scored, config=config, keys=ids)
    out = {"co2_v1": "co2_proxy", "mci_v1": "mci_proxy", "co2_pca": "co2_pca_proxy", "mci_pca": "mci_pca_proxy"}
    if config is not None:
        out |= {"co2_assumed": "co2_assumed", "mci_assumed": "mci_assumed"}
    return scored.select(*ids, "_var", "_val", "y_pred", *[F.col(c).alias(n) for n, c in out.items()])
