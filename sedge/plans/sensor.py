"""Sensor queries: line items as process rows, events as clock readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.functions.lexicon import PROXY_ASSUMPTIONS
from sedge.operators import cleaning, diagnostics, elapsed, proxies, scaling, splitting, sweep
from sedge.plans.registry import Registry, table

registry = Registry()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since engines add them in different orders."""
    return df.select(
        *[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def process_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scored sensor rows with the headers a raw file would have."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("time_s"),
        (F.col("l_discount") * 100 + F.col("l_quantity") * 0.2).alias("Temperature (°C)"),
        F.col("l_tax").alias("Stiring"),
        F.col("l_extendedprice").alias("y_pred"),
        F.when(F.col("l_linestatus") == "F", "test").otherwise("validation").alias("split"),
    )


ROWS = """
base AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS t, l_discount * 1e2 + l_quantity * 2e-1 AS c, l_tax AS s,
         l_extendedprice AS y, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'validation' END AS split
  FROM lineitem)
"""


def _scaled(x: str, part: str) -> str:
    return (
        f"CASE WHEN max({x}) OVER ({part}) - min({x}) OVER ({part}) < 1e-12 THEN 0e0 "
        f"ELSE ({x} - min({x}) OVER ({part})) / (max({x}) OVER ({part}) - min({x}) OVER ({part})) END"
    )


def scores_sql(part: str, source: str = "base", keep: str = "l_orderkey, l_linenumber, split, y") -> str:
    """CTEs ``v1``, ``pc`` and ``asm`` over the source, scaled within ``part`` (a window partition or nothing).

    The first principal axis of three columns has a closed form: with the
    correlations a, b, c the largest root of the characteristic cubic.
    """
    by = part.replace("PARTITION BY ", "")
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    cols = f"{by}, " if by else ""
    return f"""
norm AS (
  SELECT *, {_scaled("t", part)} AS tn, {_scaled("c", part)} AS cn, {_scaled("s", part)} AS sn,
         {_scaled("y", part)} AS yn, 4e-1 * t + 4e-1 * c + 2e-1 * s AS raw FROM {source}),
energy AS (
  SELECT *, 4e-1 * tn + 4e-1 * cn + 2e-1 * sn AS e1, {_scaled("raw", part)} AS e3 FROM norm),
moments AS (
  SELECT {cols} corr(t, c) AS a, corr(t, s) AS b, corr(c, s) AS d, avg(t) AS mt, avg(c) AS mc, avg(s) AS ms,
         stddev_pop(t) AS dt, stddev_pop(c) AS dc, stddev_pop(s) AS ds FROM {source} {group}),
roots AS (
  SELECT *, 2 * sqrt((a * a + b * b + d * d) / 3) * cos(acos(greatest(-1e0, least(1e0,
         a * b * d / pow((a * a + b * b + d * d) / 3, 1.5e0)))) / 3) AS r FROM moments),
axes AS (
  SELECT *, a * d + b * r AS v1, a * b + d * r AS v2, r * r - a * a AS v3 FROM roots),
signed AS (
  SELECT *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) * CASE
    WHEN abs(v1) >= greatest(abs(v2), abs(v3)) THEN sign(v1)
    WHEN abs(v2) >= abs(v3) THEN sign(v2) ELSE sign(v3) END AS len FROM axes),
projected AS (
  SELECT energy.*, v1 / len * (t - mt) / dt + v2 / len * (c - mc) / dc + v3 / len * (s - ms) / ds AS p
  FROM energy JOIN signed {join}),
scored AS (SELECT *, {_scaled("p", part)} AS e2 FROM projected),
allscores AS (
  SELECT {keep}, e1, e2, e3,
    7e-1 * e1 + 3e-1 * yn AS co2_v1, greatest(0e0, least(1e0, 1 - (6e-1 * e1 + 4e-1 * yn))) AS mci_v1,
    7e-1 * e2 + 3e-1 * yn AS co2_pca, greatest(0e0, least(1e0, 1 - (6e-1 * e2 + 4e-1 * yn))) AS mci_pca,
    7e-1 * e3 + 3e-1 * yn AS co2_assumed, greatest(0e0, least(1e0, 1 - (6e-1 * e3 + 4e-1 * yn))) AS mci_assumed,
    yn, t, c, s
  FROM scored)
"""


ALL_ROWS = f"WITH {ROWS}, {scores_sql('')}"
PER_SPLIT = f"WITH {ROWS}, {scores_sql('PARTITION BY split')}"


@registry.query(
    f"""{ALL_ROWS} SELECT l_orderkey, l_linenumber, round(e1, 6) AS energy_proxy, round(co2_v1, 6) AS co2_proxy,
round(mci_v1, 6) AS mci_proxy FROM allscores"""
)
def proxy_v1(spark: SparkSession, sf: str) -> DataFrame:
    out = proxies.weighted_proxies(process_rows(spark, sf))
    return rounded(out.select("l_orderkey", "l_linenumber", "energy_proxy", "co2_proxy", "mci_proxy"))


@registry.query(
    f"""{ALL_ROWS} SELECT l_orderkey, l_linenumber, round(e2, 6) AS energy_pca_proxy, round(co2_pca, 6) AS co2_pca_proxy,
round(mci_pca, 6) AS mci_pca_proxy FROM allscores"""
)
def proxy_pca(spark: SparkSession, sf: str) -> DataFrame:
    out = proxies.pca_proxies(process_rows(spark, sf))
    return rounded(out.select("l_orderkey", "l_linenumber", "energy_pca_proxy", "co2_pca_proxy", "mci_pca_proxy"))


@registry.query(
    f"""{ALL_ROWS} SELECT l_orderkey, l_linenumber, round(e3, 6) AS energy_assumed, round(co2_assumed, 6) AS co2_assumed,
round(mci_assumed, 6) AS mci_assumed FROM allscores"""
)
def proxy_assumed(spark: SparkSession, sf: str) -> DataFrame:
    out = proxies.assumed_proxies(process_rows(spark, sf))
    return rounded(out.select("l_orderkey", "l_linenumber", "energy_assumed", "co2_assumed", "mci_assumed"))


FORMULAS = {
    **PROXY_ASSUMPTIONS,
    "energy": {"weights": {"time": 1.0, "temperature": -0.5}, "normalize": "none"},
    "metrics": {
        "lowest": "min(energy, np.sqrt(abs(temperature - 5)))",
        "ratio": "y_pred_n / (time - 7)",
        "soft": "log1p(max(energy, 0)) + exp(-stirring) * (energy > 10) + y_pred ** 0.5",
    },
}


@registry.query(
    f"""{ALL_ROWS}, f AS (SELECT *, t - 5e-1 * c AS e FROM allscores)
SELECT l_orderkey, l_linenumber, round(e, 6) AS energy_assumed, round(least(e, sqrt(abs(c - 5))), 6) AS lowest_assumed,
  round(CASE WHEN t = 7 THEN NULL ELSE yn / (t - 7) END, 6) AS ratio_assumed,
  round(ln(1 + greatest(e, 0)) + exp(-s) * CASE WHEN e > 10 THEN 1 ELSE 0 END + sqrt(y), 6) AS soft_assumed FROM f"""
)
def proxy_formulas(spark: SparkSession, sf: str) -> DataFrame:
    out = proxies.assumed_proxies(process_rows(spark, sf), FORMULAS)
    names = ["energy_assumed", "lowest_assumed", "ratio_assumed", "soft_assumed"]
    return rounded(out.select("l_orderkey", "l_linenumber", *names))


@registry.query(
    f"""{ALL_ROWS}, r AS (SELECT *, yn / (abs(co2_v1) + 1e-6) AS eco FROM allscores)
SELECT l_orderkey, l_linenumber, round({_scaled("eco", "")}, 6) AS eco_eff_proxy FROM r"""
)
def eco_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    scored = proxies.weighted_proxies(process_rows(spark, sf))
    out = proxies.eco_efficiency(scored, "co2_proxy")
    return rounded(out.select("l_orderkey", "l_linenumber", "eco_eff_proxy"))


SCORES = ["co2_v1", "co2_pca", "co2_assumed", "mci_v1", "mci_pca", "mci_assumed"]
ROUNDED_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)


@registry.query(
    f"{PER_SPLIT} SELECT l_orderkey, l_linenumber, split, round(y, 6) AS y_pred, {ROUNDED_SCORES} FROM allscores"
)
def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    out = proxies.method_comparison(process_rows(spark, sf))
    return rounded(out.select("l_orderkey", "l_linenumber", "split", "y_pred", *SCORES))


PAIRS = [(a, b) for i, a in enumerate(SCORES) for b in SCORES[i + 1:]]


@registry.query(
    f"{PER_SPLIT} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM allscores WHERE split = 'test'"
        for a, b in PAIRS
    )
)
def method_corr(spark: SparkSession, sf: str) -> DataFrame:
    scored = proxies.method_comparison(process_rows(spark, sf)).where("split = 'test'")
    return rounded(diagnostics.correlations(scored, SCORES))


def _shift_sql(c: str) -> str:
    at = lambda s: f"{c}) FILTER (split = '{s}'"
    return f"""SELECT '{c}_mean_diff' AS metric, round(avg({at('test')}) - avg({at('validation')}), 6) AS value FROM allscores
UNION ALL SELECT '{c}_std_ratio', round(stddev_samp({at('validation')}) / (stddev_samp({at('test')}) + 1e-9), 6) FROM allscores"""


@registry.query(f"{PER_SPLIT} {_shift_sql('co2_pca')} UNION ALL {_shift_sql('mci_pca')}")
def shift_summary(spark: SparkSession, sf: str) -> DataFrame:
    scored = proxies.method_comparison(process_rows(spark, sf))
    return rounded(diagnostics.distribution_shift(scored, ["co2_pca", "mci_pca"]))


def with_gaps(df: DataFrame, column: str, key: str = "l_orderkey") -> DataFrame:
    """Every seventh key's readings as NaN."""
    return df.withColumn(column, F.when(F.col(key) % 7 == 0, F.lit(float("nan"))).otherwise(F.col(column)))


@registry.query(
    """WITH known AS (SELECT * FROM lineitem WHERE l_orderkey % 7 <> 0),
e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM known GROUP BY 1),
b AS (SELECT l_returnflag, lo, hi, least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29)::INTEGER AS bin
      FROM known JOIN e USING (l_returnflag))
SELECT l_returnflag, bin, round(lo + bin * (hi - lo) / 30, 6) AS left_edge, count(*) AS n FROM b GROUP BY l_returnflag, bin, lo, hi"""
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.histogram(with_gaps(table(spark, sf, "lineitem"), "l_extendedprice"), "l_extendedprice", 30, ["l_returnflag"]))


@registry.query(
    """WITH known AS (SELECT l_returnflag, l_quantity AS q, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice ELSE 0 END AS p FROM lineitem)
SELECT l_returnflag, round(sqrt(0.5), 6) AS quantity_loading, round(sign(corr(q, p)) * sqrt(0.5), 6) AS price_loading,
  round((1 + abs(corr(q, p))) / 2, 6) AS explained, round(avg(q), 6) AS quantity_centre, round(stddev_pop(p), 4) AS price_spread
FROM known GROUP BY 1"""
)
def pca_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings, explained share, centre and spread of the first axis per group."""
    lines = with_gaps(table(spark, sf, "lineitem"), "l_extendedprice")
    axes = proxies.energy_axes(lines, ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    at = lambda c, i, d, n: F.round(F.get(c, F.lit(i)), d).alias(n)
    return axes.select(
        "l_returnflag", at("loadings", 0, 6, "quantity_loading"), at("loadings", 1, 6, "price_loading"),
        F.round("explained", 6).alias("explained"), at("centre", 0, 6, "quantity_centre"), at("spread", 1, 4, "price_spread"),
    )


@registry.query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS var, round(quantile_cont({c}, 0.1), 6) AS lo, round(quantile_cont({c}, 0.9), 6) AS hi FROM lineitem"
        for c in ("l_extendedprice", "l_quantity", "l_discount")
    )
)
def quantile_range(spark: SparkSession, sf: str) -> DataFrame:
    variables = ["l_extendedprice", "l_quantity", "l_discount"]
    return rounded(sweep.range_table(table(spark, sf, "lineitem"), variables))


@registry.query(
    """WITH known AS (SELECT l_returnflag, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS y, l_quantity * 2000 AS p FROM lineitem)
SELECT l_returnflag, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)), 6) AS r2, count(*) AS n
FROM known GROUP BY 1"""
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = with_gaps(table(spark, sf, "lineitem"), "l_extendedprice").withColumn("y_pred", F.col("l_quantity") * 2000)
    out = diagnostics.regression_metrics(scored, "l_extendedprice", "y_pred", ["l_returnflag"])
    return out.select("l_returnflag", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), "n")


@registry.query(
    f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_quantity AS q, l_extendedprice AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, f AS l_returnflag, round({_scaled("q", "PARTITION BY f")}, 6) AS l_quantity_n,
  round({_scaled("p", "PARTITION BY f")}, 6) AS l_extendedprice_n FROM g"""
)
def minmax_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = scaling.minmax(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity_n", "l_extendedprice_n"))


@registry.query(
    """WITH known AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x FROM orders)
SELECT o_orderkey, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS o_totalprice_z, 0e0 AS flat_z FROM known"""
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    orders = with_gaps(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").withColumn("flat", F.lit(3.0))
    out = scaling.standardize(orders, ["o_totalprice", "flat"])
    return rounded(out.select("o_orderkey", "o_totalprice_z", "flat_z"))


# --- cleaning ---------------------------------------------------------------


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a raw text file would hold them: comma decimals, blanks, suffixes, garbage, clock readings."""
    value, kind = F.col("value").cast("string"), F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.replace(value, F.lit("."), F.lit(",")))
        .when(kind == 1, F.concat(F.lit(" "), value, F.lit(" ")))
        .when(kind == 2, F.concat(value, F.lit("d")))
        .when(kind == 3, "1.234,5")
        .when(kind == 4, "abc")
        .otherwise(value)
    )
    clock = F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.substring(F.col("ts").cast("string"), 12, 8))
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        "event_id", "user_id", clock.alias("time"), raw.alias("temperature"),
        F.when(F.col("event_id") % 4 != 2, k).alias("Stiring"),
        F.when(F.col("event_id") % 5 != 0, value).alias("pressure"),
    )


RAW = """
raw AS (
  SELECT event_id, user_id,
    CASE WHEN event_id % 97 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END::DOUBLE AS t,
    CASE WHEN event_id % 6 IN (0, 1, 5) THEN value END AS temperature,
    CASE WHEN event_id % 4 <> 2 THEN (props->>'$.k')::DOUBLE END AS stiring,
    CASE WHEN event_id % 5 <> 0 THEN value END AS pressure
  FROM events)
"""


@registry.query(f"WITH {RAW} SELECT event_id, temperature AS number FROM raw")
def numeric_coerce(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.numeric_columns(raw_events(spark, sf), ["temperature"])
    return out.select("event_id", F.col("temperature").alias("number"))


@registry.query(
    f"""WITH {RAW} SELECT event_id, temperature, stiring AS "Stiring", pressure FROM raw
WHERE pressure IS NOT NULL AND (temperature IS NOT NULL OR stiring IS NOT NULL)"""
)
def usable_rows(spark: SparkSession, sf: str) -> DataFrame:
    names = ["temperature", "Stiring", "pressure"]
    out = cleaning.usable_rows(cleaning.numeric_columns(raw_events(spark, sf), names), names[:2], "pressure")
    return out.select("event_id", *names)


@registry.query(
    f"""WITH {RAW}, k AS (SELECT count(*) AS n, count(*) FILTER (
  pressure IS NOT NULL AND (temperature IS NOT NULL OR stiring IS NOT NULL)) AS kept FROM raw)
SELECT n AS rows_before_clean, kept AS rows_after_clean, n - kept AS rows_dropped FROM k"""
)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    names = ["temperature", "Stiring", "pressure"]
    return cleaning.cleaning_report(cleaning.numeric_columns(raw_events(spark, sf), names), names[:2], "pressure")


@registry.query(
    """SELECT 'too_few_rows' AS rule, 'Too few rows: ' || count(*) || ' < 1000000000000.' AS detail FROM lineitem
UNION ALL SELECT 'missing_column', 'Missing required column: ''zz''.'
UNION ALL SELECT 'duplicate_columns', 'Duplicate column names: [''a''].'
UNION ALL SELECT 'all_empty', 'All rows are entirely empty.' FROM lineitem HAVING count(l_orderkey) = 0"""
)
def raw_problems(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").toDF("a", "b", "a")
    return cleaning.raw_problems(df, ["a", "zz"], 10**12)


ELAPSED = """
timed AS (
  SELECT event_id, {key} AS k,
    CASE WHEN event_id % 97 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END::DOUBLE AS t FROM events),
stepped AS (
  SELECT *, t - lag(t) OVER w AS d, row_number() OVER w = 1 AS first FROM timed WINDOW w AS (PARTITION BY k ORDER BY event_id)),
usual AS (SELECT k, median(d) FILTER (d > 0) AS m FROM stepped GROUP BY k)
SELECT event_id, {out} sum(CASE WHEN first THEN 0e0 WHEN d > 0 THEN d ELSE coalesce(m, 15e0) END)
  OVER (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS time_s
FROM stepped JOIN usual USING (k)
"""


@registry.query("WITH " + ELAPSED.format(key="user_id", out="k AS user_id,"))
def elapsed_seconds(spark: SparkSession, sf: str) -> DataFrame:
    out = elapsed.elapsed_seconds(raw_events(spark, sf), "time", ["event_id"], ["user_id"])
    return out.select("event_id", "user_id", "time_s")


@registry.query("WITH " + ELAPSED.format(key="1", out=""))
def elapsed_one_series(spark: SparkSession, sf: str) -> DataFrame:
    return elapsed.elapsed_seconds(raw_events(spark, sf), "time", ["event_id"]).select("event_id", "time_s")


# --- splits -----------------------------------------------------------------


def split_sql(key: str, holdout: float = 0.2, train_within: float = 0.8, seed: int = 42) -> str:
    """The split of a row by its hash, as SQL."""
    hex_of = lambda share: f"{round(share * 16**splitting.HASH_DIGITS):0{splitting.HASH_DIGITS}x}"
    h = f"substr(md5('{seed}:' || {key}), 1, {splitting.HASH_DIGITS})"
    inner = holdout + (1 - holdout) * (1 - train_within)
    return f"CASE WHEN {h} < '{hex_of(holdout)}' THEN 'validation' WHEN {h} < '{hex_of(inner)}' THEN 'test' ELSE 'train' END"


@registry.query(f"SELECT o_orderkey, {split_sql('o_orderkey')} AS split FROM orders")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.hash_split(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


@registry.query(f"SELECT {split_sql('o_orderkey')} AS split, count(*) AS rows FROM orders GROUP BY 1")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_sizes(splitting.hash_split(table(spark, sf, "orders"), ["o_orderkey"]))


@registry.query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY substr(md5('42:' || o_orderkey), 1, 13)) AS pos,
  count(*) OVER () AS n FROM orders), s AS (SELECT *, ceil(2e-1 * n) AS v FROM r)
SELECT o_orderkey, CASE WHEN pos <= v THEN 'validation' WHEN pos <= v + ceil((1e0 - 8e-1) * (n - v)) THEN 'test' ELSE 'train' END AS split FROM s"""
)
def exact_split(spark: SparkSession, sf: str) -> DataFrame:
    out = splitting.hash_split(table(spark, sf, "orders"), ["o_orderkey"], exact=True)
    return out.select("o_orderkey", "split")


@registry.query(
    f"""WITH s AS (SELECT o_orderstatus, CASE {split_sql('o_orderkey')} WHEN 'test' THEN 'test' ELSE 'train' END AS split FROM orders)
SELECT 'empty_split' AS rule, 'Empty val split.' AS detail FROM s HAVING count(*) FILTER (split = 'validation') = 0
UNION ALL SELECT 'null_target', 'Target contains NaN after cleaning.' FROM s HAVING count(*) FILTER (o_orderstatus = 'P') > 0"""
)
def prepared_problems(spark: SparkSession, sf: str) -> DataFrame:
    split = splitting.hash_split(table(spark, sf, "orders"), ["o_orderkey"])
    merged = F.when(F.col("split") == "test", "test").otherwise("train")
    df = split.withColumns(
        {"split": merged, "target": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))}
    )
    return cleaning.prepared_problems(df, ["o_custkey"], "target")


@registry.query(
    "WITH " + RAW + ", e AS (WITH " + ELAPSED.format(key="user_id", out="") + ")"
    + f""" SELECT event_id, user_id, round(time_s, 6) AS time_s, temperature, stiring AS "Stiring", pressure,
  {split_sql('event_id')} AS split FROM raw JOIN e USING (event_id) WHERE pressure IS NOT NULL"""
)
def prepare_sensor(spark: SparkSession, sf: str) -> DataFrame:
    done = cleaning.prepare(
        raw_events(spark, sf), ["temperature", "Stiring"], "pressure", ["event_id"],
        clock="time", order=["event_id"], keys=["user_id"],
    )
    return rounded(done.df)


# --- sweeps -----------------------------------------------------------------

SWEPT = ["time_s", "temperature", "Stiring"]


def sweep_base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("time_s"),
        (F.col("l_discount") * 100).alias("temperature"),
        (F.col("l_tax") * 50).alias("Stiring"),
        "l_partkey",
    )


def sweep_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """One baseline per brand: its smallest readings."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return sweep_base(spark, sf).join(parts, "l_partkey").groupBy("p_brand").agg(
        *[F.min(c).alias(c) for c in SWEPT]
    )


SWEEP = """
rows AS (SELECT l_quantity AS time_s, l_discount * 100 AS temperature, l_tax * 50 AS stiring, p_brand
         FROM lineitem JOIN part ON p_partkey = l_partkey),
lows AS (SELECT p_brand, min(time_s) AS t, min(temperature) AS c, min(stiring) AS s FROM rows GROUP BY 1),
ranges AS (
  SELECT 'time_s' AS var, quantile_cont(l_quantity, 0.1) AS lo, quantile_cont(l_quantity, 0.9) AS hi FROM lineitem
  UNION ALL SELECT 'temperature', quantile_cont(l_discount * 100, 0.1), quantile_cont(l_discount * 100, 0.9) FROM lineitem
  UNION ALL SELECT 'Stiring', quantile_cont(l_tax * 50, 0.1), quantile_cont(l_tax * 50, 0.9) FROM lineitem),
grid AS (SELECT var, lo + i * (hi - lo) / 24 AS val FROM ranges, range(25) AS g(i)),
swept AS (
  SELECT p_brand, var, val, CASE WHEN var = 'time_s' THEN val ELSE t END AS t,
    CASE WHEN var = 'temperature' THEN val ELSE c END AS c, CASE WHEN var = 'Stiring' THEN val ELSE s END AS s
  FROM lows, grid),
base AS (SELECT *, 1e-2 * c + 5e-1 * s AS y FROM swept)
"""


@registry.query(
    f"""WITH {SWEEP} SELECT p_brand, var AS _var, round(val, 6) AS _val, round(t, 6) AS time_s, round(c, 6) AS temperature,
round(s, 6) AS "Stiring" FROM swept"""
)
def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    grids = sweep.build_grids(sweep.scenario_ranges(sweep_base(spark, sf), SWEPT), 25)
    out = sweep.one_way(sweep_baselines(spark, sf), grids)
    return rounded(out.select("p_brand", "_var", "_val", *SWEPT))


@registry.query(
    f"""WITH {SWEEP}, {scores_sql("PARTITION BY p_brand", keep="p_brand, var, val, y")}
SELECT p_brand, var AS _var, round(val, 6) AS _val, round(y, 6) AS y_pred, {ROUNDED_SCORES} FROM allscores"""
)
def sweep_scores(spark: SparkSession, sf: str) -> DataFrame:
    scorer = lambda df: df.withColumn("y_pred", F.lit(0.01) * F.col("temperature") + F.lit(0.5) * F.col("Stiring"))
    base = sweep_base(spark, sf).drop("l_partkey")
    out = sweep.run_sweep(
        scorer, base, sweep_baselines(spark, sf), SWEPT, 25, PROXY_ASSUMPTIONS, ids=["p_brand"]
    )
    return rounded(out.select("p_brand", "_var", "_val", "y_pred", *SCORES)).orderBy("p_brand", "_var", "_val")
