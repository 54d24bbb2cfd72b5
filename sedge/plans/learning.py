"""Model queries: regressors over line items, text coders over labeled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.functions.lexicon import TERM_STOPWORDS
from sedge.operators import coder, regress, text_models
from sedge.operators.splitting import hash_split
from sedge.plans.documents import STOP
from sedge.plans.registry import Registry, table
from sedge.plans.sensor import split_sql
from sedge.session import scratch_path

registry = Registry()

ID = ["l_orderkey", "l_linenumber"]


def line_split(spark: SparkSession, sf: str) -> DataFrame:
    return hash_split(table(spark, sf, "lineitem", "l_orderkey"), ID)


LINE_SPLIT = split_sql("l_orderkey || ':' || l_linenumber")


@registry.query(
    f"""WITH rows AS (SELECT l_quantity AS x, l_extendedprice AS y, {LINE_SPLIT} AS split FROM lineitem),
fit AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM rows WHERE split = 'train'),
m AS (SELECT split, sqrt(avg(pow(y - a * x - b, 2))) AS rmse, 1 - sum(pow(y - a * x - b, 2)) / (var_pop(y) * count(*)) AS r2
      FROM rows, fit WHERE split <> 'train' GROUP BY split)
SELECT 'linreg' AS model, round(max(rmse) FILTER (split = 'test'), 3) AS rmse_test, round(max(r2) FILTER (split = 'test'), 6) AS r2_test,
  round(max(rmse) FILTER (split = 'validation'), 3) AS rmse_val, round(max(r2) FILTER (split = 'validation'), 6) AS r2_val FROM m"""
)
def regression_line(spark: SparkSession, sf: str) -> DataFrame:
    done = regress.train_models(line_split(spark, sf), ["l_quantity"], "l_extendedprice", ID, enabled=["linreg"])
    rounded = [F.round(c, d).alias(c) for c, d in (("rmse_test", 3), ("r2_test", 6), ("rmse_val", 3), ("r2_val", 6))]
    return done.leaderboard.select("model", *rounded)


ENET = {"alpha": 4.0, "l1_ratio": 0.5}


@registry.query(
    f"""WITH rows AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, {LINE_SPLIT} AS split FROM lineitem),
t AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_samp(x) AS c, var_pop(x) / var_samp(x) AS v
      FROM rows WHERE split = 'train'),
w AS (SELECT *, sign(c) * greatest(abs(c) - {ENET["alpha"] * ENET["l1_ratio"]}, 0) / (v + {ENET["alpha"] * (1 - ENET["l1_ratio"])}) AS w FROM t),
m AS (SELECT split, sqrt(avg(pow(y - my - w * (x - mx) / sx, 2))) AS rmse,
             1 - sum(pow(y - my - w * (x - mx) / sx, 2)) / (var_pop(y) * count(*)) AS r2 FROM rows, w WHERE split <> 'train' GROUP BY split)
SELECT 'enet' AS model, round(max(rmse) FILTER (split = 'test'), 3) AS rmse_test, round(max(r2) FILTER (split = 'test'), 4) AS r2_test,
  round(max(rmse) FILTER (split = 'validation'), 3) AS rmse_val, round(max(r2) FILTER (split = 'validation'), 4) AS r2_val FROM m"""
)
def regression_enet(spark: SparkSession, sf: str) -> DataFrame:
    """The elastic net on one feature, where its coefficient is a soft threshold; unknown model names are ignored."""
    rows = line_split(spark, sf).withColumn("price", F.col("l_extendedprice") / 1000)
    grid = {"enet": {"alpha": [ENET["alpha"]], "l1_ratio": [ENET["l1_ratio"]]}}
    done = regress.train_models(rows, ["l_quantity"], "price", ID, enabled=["enet", "unknown"], grids=grid)
    rounded = [F.round(c, d).alias(c) for c, d in (("rmse_test", 3), ("r2_test", 4), ("rmse_val", 3), ("r2_val", 4))]
    return done.leaderboard.select("model", *rounded)


STEP_GRIDS = {
    "rf": {"n_estimators": [5], "max_depth": [3], "min_samples_split": [2]},
    "gbr": {"n_estimators": [3], "learning_rate": [0.1], "max_depth": [2]},
}


@registry.query("SELECT unnest(['gbr', 'rf']) AS model, 0e0 AS rmse_test, 1e0 AS r2_test, 0e0 AS rmse_val, 1e0 AS r2_val FROM (SELECT 1 FROM lineitem LIMIT 1)")
def regression_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A step in one feature, which forests and boosted trees must hit on every row."""
    rows = line_split(spark, sf).withColumn("step", F.when(F.col("l_linenumber") >= 4, 10.0).otherwise(0.0))
    done = regress.train_models(rows, ["l_linenumber", "l_tax"], "step", ID, enabled=["rf", "gbr"], grids=STEP_GRIDS)
    return done.leaderboard.select("model", *[F.round(c, 9).alias(c) for c in ("rmse_test", "r2_test", "rmse_val", "r2_val")])


def _board(done: regress.Trained) -> DataFrame:
    rounded = {c: F.round(c, d) for c, d in (("rmse_test", 3), ("r2_test", 6), ("rmse_val", 3), ("r2_val", 6))}
    return done.leaderboard.drop("fit_seconds").withColumns(rounded)


FEATURES = ["l_quantity", "l_discount", "l_tax"]
LINE_FOLD = "(('0x' || substr(md5('43:' || l_orderkey || ':' || l_linenumber), 1, 13))::BIGINT % 5)"
# Coordinate descent on the standardised moments of every training set (all train rows but a fold's, and all of them as number 5), for every grid point
# and, as a point without penalty, for least squares.
LINEAR = f"""
rows AS MATERIALIZED (
  SELECT l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_tax::DOUBLE AS x3, l_extendedprice::DOUBLE AS y, {LINE_SPLIT} AS split, {LINE_FOLD} AS fold
  FROM lineitem),
sets AS (SELECT g, rows.* FROM rows, (SELECT unnest(range(6)) AS g) WHERE split = 'train' AND fold <> g),
facts AS MATERIALIZED (
  SELECT g, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, stddev_samp(x1) AS s1, stddev_samp(x2) AS s2, stddev_samp(x3) AS s3,
    var_pop(x1) / var_samp(x1) AS v, covar_pop(x1, x2) / (s1 * s2) AS g12, covar_pop(x1, x3) / (s1 * s3) AS g13, covar_pop(x2, x3) / (s2 * s3) AS g23,
    covar_pop(x1, y) / s1 AS c1, covar_pop(x2, y) / s2 AS c2, covar_pop(x3, y) / s3 AS c3
  FROM sets GROUP BY g),
points AS (
  SELECT a.nr * 3 + r.nr AS nr, a.text AS alpha, r.text AS ratio, a.text::DOUBLE * r.text::DOUBLE AS absolute, a.text::DOUBLE * (1 - r.text::DOUBLE) AS squared
  FROM (VALUES (0, '0.01'), (1, '0.1'), (2, '1.0')) a(nr, text), (VALUES (0, '0.1'), (1, '0.5'), (2, '0.9')) r(nr, text)
  UNION ALL SELECT -1, NULL, NULL, 0, 0),
descent AS (
  SELECT g, nr, 0 AS turn, 0e0 AS w1, 0e0 AS w2, 0e0 AS w3 FROM facts, points
  UNION ALL
  SELECT g, nr, turn + 1, n1, n2, sign(c3 - g13 * n1 - g23 * n2) * greatest(abs(c3 - g13 * n1 - g23 * n2) - absolute, 0) / (v + squared)
  FROM (
    SELECT *, sign(c2 - g12 * n1 - g23 * w3) * greatest(abs(c2 - g12 * n1 - g23 * w3) - absolute, 0) / (v + squared) AS n2
    FROM (
      SELECT d.*, f.* EXCLUDE (g), p.absolute, p.squared,
        sign(c1 - g12 * w2 - g13 * w3) * greatest(abs(c1 - g12 * w2 - g13 * w3) - absolute, 0) / (v + squared) AS n1
      FROM descent d JOIN facts f ON f.g = d.g JOIN points p ON p.nr = d.nr WHERE turn < 60))),
fits AS MATERIALIZED (SELECT d.*, f.* EXCLUDE (g) FROM descent d JOIN facts f ON f.g = d.g WHERE turn = 60),
errors AS (
  SELECT g, nr, sqrt(avg(pow(y - my - w1 * (x1 - m1) / s1 - w2 * (x2 - m2) / s2 - w3 * (x3 - m3) / s3, 2))) AS rmse
  FROM fits JOIN rows ON rows.fold = fits.g WHERE split = 'train' GROUP BY ALL),
best AS (
  SELECT 'linreg' AS model, -1 AS nr
  UNION ALL SELECT * FROM (SELECT 'enet', nr FROM errors WHERE nr >= 0 GROUP BY nr ORDER BY avg(rmse), nr LIMIT 1)),
judged AS (
  SELECT model, split, sqrt(avg(pow(e, 2))) AS rmse, 1 - sum(pow(e, 2)) / (var_pop(y) * count(*)) AS r2
  FROM (SELECT model, split, y, y - my - w1 * (x1 - m1) / s1 - w2 * (x2 - m2) / s2 - w3 * (x3 - m3) / s3 AS e
        FROM best JOIN fits ON fits.nr = best.nr AND fits.g = 5, rows WHERE split <> 'train') GROUP BY ALL)
"""


@registry.query(
    f"""WITH RECURSIVE {LINEAR}
SELECT model, round(max(rmse) FILTER (split = 'test'), 3) AS rmse_test, round(max(r2) FILTER (split = 'test'), 6) AS r2_test,
  round(max(rmse) FILTER (split = 'validation'), 3) AS rmse_val, round(max(r2) FILTER (split = 'validation'), 6) AS r2_val,
  CASE model WHEN 'linreg' THEN '{{}}' ELSE '{{"alpha": ' || max(alpha) || ', "l1_ratio": ' || max(ratio) || '}}' END AS best_params
FROM judged JOIN best USING (model) JOIN points USING (nr) GROUP BY model"""
)
def regression_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares and all nine points of the elastic net in five folds."""
    done = regress.train_models(line_split(spark, sf), FEATURES, "l_extendedprice", ID, enabled=["linreg", "enet", "unknown"])
    return _board(done)


@registry.query()
def regression_trees(spark: SparkSession, sf: str) -> DataFrame:
    """All points of both tree models' grids in five folds."""
    return _board(regress.train_models(line_split(spark, sf), FEATURES, "l_extendedprice", ID, enabled=["rf", "gbr"]))


# --- text coders ------------------------------------------------------------


def labeled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labeled documents as rows ``(doc_id, text, task, label)``."""
    labels = table(spark, sf, "labels").select(
        "doc_id",
        F.inline(
            F.array(
                F.struct(F.lit("quality").alias("task"), F.col("quality").alias("y")),
                F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("y")),
            )
        ),
    )
    label = F.when(F.col("y") == 1, "yes").when(F.col("y") == 0, "no")
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return labels.select("doc_id", "task", label.alias("label")).join(texts, "doc_id")


LABELS = """
labeled AS (
  SELECT doc_id, 'quality' AS task, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS label, text FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'toxic', CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END, text FROM labels JOIN documents USING (doc_id))
"""


@registry.query(f"WITH {LABELS} SELECT task, label, count(*) AS n FROM labeled WHERE label IS NOT NULL GROUP BY ALL")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return coder.class_counts(labeled_documents(spark, sf))


@registry.query(
    f"""WITH {LABELS} SELECT doc_id, label, ((row_number() OVER (PARTITION BY label
  ORDER BY substr(md5('42:' || doc_id), 1, 13), doc_id) - 1) % 5)::INTEGER AS fold FROM labeled WHERE task = 'quality'"""
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeled_documents(spark, sf).where("task = 'quality'")
    return coder.with_folds(rows, "doc_id", 5).select("doc_id", "label", "fold")


def rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two fixed rules in five folds, to check the scores against SQL."""
    rules = F.array(
        F.struct(F.lit("long").alias("model"), F.when(F.length("text") > 1500, "yes").otherwise("no").alias("predicted")),
        F.struct(F.lit("vowel").alias("model"), F.when(F.contains("text", F.lit("the")), "yes").otherwise("maybe").alias("predicted")),
    )
    fold = F.pmod(F.col("doc_id"), F.lit(5)).cast("int").alias("fold")
    return labeled_documents(spark, sf).select("task", fold, "doc_id", "label", F.inline(rules))


PREDICTIONS = f"""{LABELS},
predictions AS (
  SELECT task, 'long' AS model, (doc_id % 5)::INTEGER AS fold, label, CASE WHEN length(text) > 1500 THEN 'yes' ELSE 'no' END AS predicted FROM labeled
  UNION ALL SELECT task, 'vowel', (doc_id % 5)::INTEGER, label, CASE WHEN contains(text, 'the') THEN 'yes' ELSE 'maybe' END FROM labeled),
classes AS (SELECT DISTINCT task, model, fold, unnest([label, predicted]) AS class FROM predictions),
per_class AS (
  SELECT c.task, c.model, c.fold, class, count(*) FILTER (label = class AND predicted = class) AS tp,
    count(*) FILTER (label = class AND predicted <> class) AS fn, count(*) FILTER (label <> class AND predicted = class) AS fp
  FROM classes c JOIN predictions p ON p.task = c.task AND p.model = c.model AND p.fold = c.fold GROUP BY ALL),
folds AS (
  SELECT p.task, p.model, p.fold, f1, avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END) AS accuracy, count(*) AS n
  FROM predictions p JOIN (SELECT task, model, fold, avg(2 * tp / (2 * tp + fn + fp)) AS f1 FROM per_class GROUP BY ALL) f
    ON f.task = p.task AND f.model = p.model AND f.fold = p.fold GROUP BY ALL),
summary AS (
  SELECT task, model, round(avg(f1), 6) AS f1_macro, round(stddev_pop(f1), 6) AS f1_macro_std, round(avg(accuracy), 6) AS accuracy,
    sum(n)::BIGINT AS n, count(*) AS cv_folds FROM folds GROUP BY ALL)
"""


def _rounded_summary(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("f1_macro", "f1_macro_std", "accuracy")})


@registry.query(f"WITH {PREDICTIONS} SELECT * FROM summary")
def coder_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_summary(coder.cv_summary(coder.fold_scores(rule_predictions(spark, sf))))


@registry.query(
    f"WITH {PREDICTIONS} SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY task ORDER BY f1_macro DESC, accuracy DESC, model) = 1"
)
def best_coders(spark: SparkSession, sf: str) -> DataFrame:
    scores = _rounded_summary(coder.cv_summary(coder.fold_scores(rule_predictions(spark, sf))))
    return coder.best_per_task(scores)


@registry.query(f"WITH {PREDICTIONS} SELECT task, model, label, predicted, count(*) AS n FROM predictions GROUP BY ALL")
def coder_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return coder.confusion(rule_predictions(spark, sf))


BAYES = f"""{LABELS},
ranked AS (
  SELECT doc_id, task, label, row_number() OVER (PARTITION BY task, label ORDER BY substr(md5('42:' || doc_id), 1, 13), doc_id) - 1 AS rank
  FROM labeled WHERE label IS NOT NULL),
per_class AS (SELECT task, label, count(*) AS n FROM ranked GROUP BY ALL),
folds AS (SELECT task, least(5, min(n)) AS folds FROM per_class GROUP BY task HAVING count(*) > 1 AND min(n) > 1),
dealt AS MATERIALIZED (SELECT doc_id, task, label, (rank % folds)::INTEGER AS fold FROM ranked JOIN folds USING (task)),
worded AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP}, w)) AS w
  FROM documents WHERE doc_id IN (SELECT doc_id FROM dealt)),
counts AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM worded) GROUP BY ALL),
by_fold AS MATERIALIZED (SELECT task, fold, term, count(*) AS df, sum(tf) AS tf FROM counts JOIN dealt USING (doc_id) GROUP BY ALL),
whole AS (SELECT task, term, sum(df) AS df, sum(tf) AS tf FROM by_fold GROUP BY ALL HAVING sum(df) >= 2),
sets AS MATERIALIZED (SELECT d.task, s.fold, count(*) AS n FROM dealt d JOIN (SELECT DISTINCT task, fold FROM dealt) s ON s.task = d.task AND s.fold <> d.fold GROUP BY ALL),
kept AS MATERIALIZED (
  SELECT task, fold, term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
    SELECT s.task, s.fold, n, w.term, w.df - coalesce(b.df, 0) AS df, w.tf - coalesce(b.tf, 0) AS tf
    FROM whole w JOIN sets s USING (task) LEFT JOIN by_fold b ON b.task = s.task AND b.fold = s.fold AND b.term = w.term)
  WHERE df >= 2 QUALIFY row_number() OVER (PARTITION BY task, fold ORDER BY tf DESC, term) <= 20000),
raw AS (
  SELECT k.task, k.fold AS set, d.doc_id, d.label, d.fold, term, (1 + ln(tf)) * idf AS r
  FROM counts JOIN dealt d USING (doc_id) JOIN kept k USING (task, term)),
weights AS MATERIALIZED (SELECT * EXCLUDE (r), r / sqrt(sum(r * r) OVER (PARTITION BY task, set, doc_id)) AS x FROM raw),
sums AS (SELECT task, set, label, term, sum(x) AS s FROM weights WHERE fold <> set GROUP BY ALL),
size AS (SELECT task, fold AS set, count(*) AS v FROM kept GROUP BY ALL),
share AS (SELECT d.task, s.fold AS set, d.label, count(*) / max(s.n) AS share FROM dealt d JOIN sets s ON s.task = d.task AND s.fold <> d.fold GROUP BY ALL),
totals AS MATERIALIZED (
  SELECT h.task, h.set, h.label, ln(share) AS prior, coalesce(sum(s), 0) + max(v) AS total
  FROM share h JOIN size z ON z.task = h.task AND z.set = h.set LEFT JOIN sums s ON s.task = h.task AND s.set = h.set AND s.label = h.label GROUP BY h.task, h.set, h.label, share),
evidence AS (
  SELECT w.task, w.doc_id, t.label AS class, sum(x * ln((coalesce(s, 0) + 1) / total)) AS e
  FROM weights w JOIN totals t ON t.task = w.task AND t.set = w.set
    LEFT JOIN sums s ON s.task = w.task AND s.set = w.set AND s.label = t.label AND s.term = w.term
  WHERE w.fold = w.set GROUP BY ALL)
"""


@registry.query(
    f"""WITH {BAYES} SELECT d.task, 'nb' AS model, d.fold, d.doc_id, d.label, t.label AS predicted
FROM dealt d JOIN totals t ON t.task = d.task AND t.set = d.fold LEFT JOIN evidence e ON e.task = d.task AND e.doc_id = d.doc_id AND e.class = t.label
QUALIFY row_number() OVER (PARTITION BY d.task, d.doc_id ORDER BY prior + coalesce(e, 0) DESC, t.label) = 1"""
)
def bayes_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of naive Bayes over whole texts, all tasks and folds from one table of counts."""
    rows, texts = labeled_documents(spark, sf), table(spark, sf, "documents").select("doc_id", "text")
    design = text_models.build(texts, rows.select("doc_id", "task", "label"), "doc_id", stopwords=TERM_STOPWORDS)
    return text_models.cross_validated(design, "doc_id", ["nb"])


@registry.query()
def linear_coders(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of both linear models for all tasks, five folds, whole texts."""
    rows, texts = labeled_documents(spark, sf), table(spark, sf, "documents").select("doc_id", "text")
    design = text_models.build(texts, rows.select("doc_id", "task", "label"), "doc_id")
    return _rounded_summary(coder.cv_summary(coder.fold_scores(text_models.cross_validated(design, "doc_id", text_models.LINEAR))))


@registry.query()
def text_coder_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeled_documents(spark, sf).where("task = 'quality'")
    done = coder.evaluate_task(rows, "quality", "doc_id")
    return coder.cv_summary(coder.fold_scores(done.predictions))


@registry.query()
def coder_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeled_documents(spark, sf)
    texts = table(spark, sf, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "coder")
    coder.run_coding(texts, rows.select("doc_id", "task", "label"), folder, "doc_id")
    return coder.predict_codes(folder, texts.withColumnRenamed("text", "body"), F.col("body")).drop("body")


def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labeled documents whose text names the label: ``(doc_id, text, label)``."""
    good = F.col("quality") == 1
    marked = F.concat_ws(" ", "source", "lang", F.when(good, "clean record").otherwise("noisy record"))
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").where("quality is not null")
    return rows.select("doc_id", marked.alias("text"), F.when(good, "yes").otherwise("no").alias("label"))


@registry.query(
    """SELECT 'quality' AS task, unnest(['linear_svc', 'logreg', 'nb', 'rf']) AS model, 1e0 AS f1_macro, 0e0 AS f1_macro_std, 1e0 AS accuracy,
  count(*) AS n, 5::BIGINT AS cv_folds FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL"""
)
def text_coder_separable(spark: SparkSession, sf: str) -> DataFrame:
    """Every text model, five folds: a word names the class, so each held-out row must be right."""
    done = coder.evaluate_task(marked_documents(spark, sf), "quality", "doc_id", models=coder.TEXT_MODELS, cv=5, trees=20)
    return _rounded_summary(coder.cv_summary(coder.fold_scores(done.predictions)))


@registry.query(
    """SELECT doc_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS pred_quality FROM labels JOIN documents USING (doc_id)
WHERE quality IS NOT NULL"""
)
def coder_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Models evaluated, refitted, saved, loaded and applied to the rows they must tell apart."""
    rows = marked_documents(spark, sf)
    folder = scratch_path(spark, "coder")
    targets = rows.select("doc_id", F.lit("quality").alias("task"), "label")
    coder.run_coding(rows.select("doc_id", "text"), targets, folder, "doc_id", models=["logreg", "nb"], cv=5)
    marked = rows.select("doc_id", F.col("text").alias("body"))
    return coder.predict_codes(folder, marked, F.col("body")).drop("body")
