"""Scenario metrics over saved portfolios of grants and policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.lexicon import MITIGATION, SAVINGS
from sedge.functions.text import has_term, literal
from sedge.operators.ordering import join_keys, positions
from sedge.session import materialized

CONFIDENCE_CAP, CONFIDENCE_FLOOR = 75, 5


def scenario_metrics(
    docs: DataFrame,
    scenarios: DataFrame | None = None,
    mitigation: Sequence[Mapping] = MITIGATION,
    savings: Sequence[Mapping] = SAVINGS,
) -> DataFrame:
    """One row of metrics per scenario.

    ``docs``: ``scenario, kind, budgetEUR, source, text``. ``scenarios``, if
    given: ``scenario, topics`` (array); it may hold scenarios without documents.
    The assumption entries are a small config: their whole-word tests are part of
    the projection, and per scenario only one flag per entry is aggregated.
    """
    entries = [*mitigation, *savings]
    hit = lambda name: [F.coalesce(has_term("text", *e["match_terms"]), F.lit(False)).alias(f"{name}{i}") for i, e in enumerate(entries)]
    grant = F.col("kind") == "grant"
    budget = F.nullif(F.col("budgetEUR"), F.lit(0).cast("long"))
    known = grant & budget.isNotNull()
    marked = docs.select("scenario", "kind", "budgetEUR", "source", *hit("_h"))
    counted = marked.groupBy("scenario").agg(
        F.count("*").alias("_docs"),
        F.count_if(F.col("kind") == "policy").alias("n_policies"),
        F.count_if(grant).alias("n_grants"),
        F.coalesce(F.sum(F.when(known, budget)), F.lit(0)).alias("_funding"),
        F.count_if(known).alias("_known"),
        F.bool_or(F.coalesce(F.col("source") != "live", F.lit(True))).alias("_stale"),
        *[F.bool_or(f"_h{i}").alias(f"_h{i}") for i in range(len(entries))],
    )
    if scenarios is not None:
        spoken = scenarios.select("scenario", F.lower(F.concat_ws(" ", "topics")).alias("text"))
        asked = spoken.select("scenario", *hit("_t"))
        counted = join_keys(asked, counted, ["scenario"])
        counted = counted.withColumns(
            {f"_h{i}": F.expr(f"coalesce(_h{i}, false) OR _t{i}") for i in range(len(entries))}
        ).na.fill(0, ["_docs", "n_policies", "n_grants", "_funding", "_known"]).na.fill(False, ["_stale"])
    return _metrics(counted, mitigation, savings)


def _metrics(counted: DataFrame, mitigation: Sequence[Mapping], savings: Sequence[Mapping]) -> DataFrame:
    flags = [f"_h{i}" for i in range(len(mitigation) + len(savings))]
    topics = list(zip(flags, mitigation))
    drivers = list(zip(flags[len(mitigation):], savings))
    sectoral = [(h, e) for h, e in topics if e["gtco2e_yr"][1] > 0]

    def total(pairs: Sequence, kind: str, amount) -> Column:
        parts = [f"if({h}, {amount(e)!r}, 0)" for h, e in pairs] or ["0"]
        return F.expr(f"cast({' + '.join(parts)} AS {kind})")

    def listed(pairs: Sequence, value) -> Column:
        return F.expr(f"array_compact(array({', '.join(f'if({h}, {value(e)}, NULL)' for h, e in pairs)}))")

    def example(e: Mapping) -> str:
        tasks = ", ".join(map(literal, e["example_tasks"][:2]))
        return f"named_struct('topic', {literal(e['topic'])}, 'tasks', array({tasks}))"

    with_tasks = sorted((p for p in sectoral if p[1].get("example_tasks")), key=lambda p: -p[1]["score"])
    topic = lambda e: literal(e["topic"])
    out = counted.select(
        "scenario",
        "n_policies",
        "n_grants",
        F.floor(F.col("_funding") * 0.25 + 0.5).cast("long").alias("funding_low_eur"),
        F.col("_funding").alias("funding_high_eur"),
        (F.col("n_grants") - F.col("_known")).alias("funding_unknown"),
        total(drivers, "bigint", lambda e: e["save_eur_yr"][0]).alias("save_low_eur"),
        total(drivers, "bigint", lambda e: e["save_eur_yr"][1]).alias("save_high_eur"),
        listed(drivers, lambda e: literal(e["driver"])).alias("matched_savers"),
        total(topics, "bigint", lambda e: e["score"]).alias("co2_index"),
        total(topics, "double", lambda e: e["gtco2e_yr"][0]).alias("co2_low_gt"),
        total(topics, "double", lambda e: e["gtco2e_yr"][1]).alias("co2_high_gt"),
        listed(topics, topic).alias("matched_topics"),
        listed(sectoral, topic).alias("sectoral_topics"),
        F.slice(listed(with_tasks, example), 1, 2).alias("example_tasks"),
        F.col("_docs"),
        F.col("_stale"),
    )
    confidence = _confidence().cast("long")
    label = F.when(confidence >= 60, "High").when(confidence >= 40, "Medium").otherwise("Low")
    return out.withColumns({"confidence": confidence, "confidence_label": label}).drop("_docs", "_stale")


def _confidence() -> Column:
    """Data-completeness rating in 5..75."""
    grants, matched = F.col("n_grants"), F.size("matched_topics")
    missing = F.when(grants > 0, F.col("funding_unknown") / F.when(grants > 0, grants)).otherwise(1.0)
    off = F.floor(40 * missing + 0.5)
    off = off + F.when(F.col("_docs") < 3, 25).when(F.col("_docs") < 6, 10).otherwise(0)
    few_sectoral = (matched > 0) & (2 * F.size("sectoral_topics") < matched)
    off = off + F.when(few_sectoral, 10).otherwise(0) + F.when(F.col("_stale"), 5).otherwise(0)
    return F.least(F.lit(CONFIDENCE_CAP), F.greatest(F.lit(CONFIDENCE_FLOOR), CONFIDENCE_CAP - off))


def _millions(amount: Column) -> Column:
    """EUR in millions with thousands separators and at most one decimal."""
    return F.regexp_replace(F.format_number(F.round(amount / 1e6, 1), 1), r"\.0$", "")


def _plural(n: Column, ending: str = "s") -> Column:
    return F.when(n > 1, ending).otherwise("")


def with_recommendation(metrics: DataFrame) -> DataFrame:
    """Add ``recommendation``: the next steps of each scenario in words."""
    # The sentences.
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    grants, unknown = c("n_grants"), c("funding_unknown")
    upside = text(" (plus ", unknown.cast("string"), " topic", _plural(unknown), " without budget data as upside)")
    funding = text(
        "To realise the funding potential, prepare consortium proposals for the ", grants.cast("string"),
        " Horizon topic", _plural(grants), " in this scenario — realistically €", _millions(c("funding_low_eur")),
        "–", _millions(c("funding_high_eur")), " M of the published call budgets",
        F.when(unknown > 0, upside).otherwise(""), ".",
    )
    policies = c("n_policies")
    anchor = text(
        "Anchor the work explicitly in the ", policies.cast("string"), " matching polic",
        F.when(policies > 1, "ies").otherwise("y"), " to demonstrate EU policy alignment in the proposal.",
    )
    sectoral = c("sectoral_topics")
    carried = text(
        "The CO₂ mitigation potential is carried by ", F.concat_ws(", ", F.slice(sectoral, 1, 3)), " — make ",
        F.when(F.size(sectoral) > 1, "these").otherwise("this"), " the technical core of the work plan.",
    )
    steps = F.transform(
        "example_tasks",
        lambda e: text(
            "Exemplary first operational steps for ", F.lower(e["topic"]), ": (1) ", F.get(e["tasks"], F.lit(0)),
            F.coalesce(text("; (2) ", F.get(e["tasks"], F.lit(1))), F.lit("")), ".",
        ),
    )
    savers = c("matched_savers")
    savings = text(
        "Cost savings would come mainly from ", F.lower(F.concat_ws("; ", F.slice(savers, 1, 3))),
        " (indicative €", _millions(c("save_low_eur")), "–", _millions(c("save_high_eur")),
        " M/yr for a typical actor) — quantify these with site-specific data before any investment decision.",
    )
    firm_up = text(
        " — firm up by ",
        F.when(unknown > 0, "adding budget data for the open topics").otherwise("including more matching documents"),
        " and by verifying the linked source documents.",
    )
    trust = text(
        "Confidence: ", c("confidence_label"), " (", c("confidence").cast("string"),
        "/75 — capped, this is a keyword screening)",
        F.when(c("confidence") < 60, firm_up).otherwise(
            "; verify against the linked source documents before committing resources."
        ),
    )
    sentences = F.concat(
        F.array(
            F.when(grants > 0, funding).otherwise(
                "This scenario contains no grants yet — add matching Horizon topics before pursuing it."
            ),
            F.when(policies > 0, anchor),
            F.when(F.size(sectoral) > 0, carried),
        ),
        steps,
        F.array(F.when(F.size(savers) > 0, savings), trust),
    )
    return metrics.withColumn("recommendation", F.concat_ws(" ", F.array_compact(sentences)))


def rank_sums(
    metrics: DataFrame, index: str, portfolio: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add ``rank_sum``: positions by funding, CO2 index and savings, each best first, ties by ``index``.

    Positions come from :func:`positions`, so one huge portfolio is no single task.
    """
    judged = metrics.withColumns(
        {
            "_f": -(F.col("funding_low_eur") + F.col("funding_high_eur")),
            "_c": -F.col("co2_index"),
            "_s": -(F.col("save_low_eur") + F.col("save_high_eur")),
        }
    )
    # Each ranking reads its input more than once.
    judged = materialized(judged, "portfolio")
    rows = judged.count()
    for measure in ("_f", "_c", "_s"):
        judged = positions(judged, [measure, index], f"{measure}_rank", portfolio, ranges, rows)
    ranks = [F.col(f"{m}_rank") for m in ("_f", "_c", "_s")]
    return judged.withColumn("rank_sum", ranks[0] + ranks[1] + ranks[2]).drop(
        *[f"{m}{s}" for m in ("_f", "_c", "_s") for s in ("", "_rank")]
    )


def best_scenario(
    metrics: DataFrame, index: str, portfolio: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """The scenario with the lowest rank sum per portfolio, the first one on a tie."""
    ranked = rank_sums(metrics, index, portfolio, ranges)
    best = F.min_by(F.struct("scenario", "rank_sum"), F.struct("rank_sum", index)).alias("_best")
    return ranked.groupBy(*portfolio).agg(best, F.count("*").alias("scenarios")).select(
        *portfolio, "_best.scenario", "_best.rank_sum", "scenarios"
    )


def metrics_export(metrics: DataFrame) -> DataFrame:
    """The 15 columns of the metrics file, lists joined by ``; ``."""
    return metrics.select(
        "scenario",
        F.col("n_policies").alias("policies"),
        F.col("n_grants").alias("grants"),
        F.col("funding_low_eur").alias("funding_eur_low"),
        F.col("funding_high_eur").alias("funding_eur_high"),
        F.col("funding_unknown").alias("grants_without_budget"),
        F.col("save_low_eur").alias("cost_saving_eur_yr_low"),
        F.col("save_high_eur").alias("cost_saving_eur_yr_high"),
        "co2_index",
        F.col("co2_low_gt").alias("co2_gt_low"),
        F.col("co2_high_gt").alias("co2_gt_high"),
        "confidence",
        "confidence_label",
        F.array_join("matched_topics", "; ").alias("matched_topics"),
        F.array_join("matched_savers", "; ").alias("matched_saving_drivers"),
    )
