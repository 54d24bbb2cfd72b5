"""URL rules found through their rarest literal token.

A rule is a regular expression with literal tokens that every URL it fits must have. Each rule is filed under
the one token that the fewest URLs have. A URL's own tokens fetch the rules filed under
them, and only those run their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules sent to every task; beyond this number they are joined by token like any table.
BROADCAST_RULES = 20_000
ANY = "any:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Host words that block a page when no listed rule fits.
UNWANTED = ("adult", "casino", "porn", "viagra", "warez", "xxx")


@dataclass(frozen=True)
class Rule:
    """``name`` is null for rules of the method itself, which lose against listed ones."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    size: int


def listed(verdict: str, host: str, path: str) -> Rule:
    """Fits a host, its subdomains, and paths that start with ``path``."""
    whole = path.split("/")[:-1]  # the last part may go on in the URL, so it is no token
    tokens = [f"host:{w}" for w in re.split(r"[.-]", host) if w] + [f"path:{w}" for w in whole if w]
    pattern = rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}" if host else rf"(?s)^[^/]*{re.escape(path)}"
    return Rule(host + path, verdict, pattern, tuple(tokens) or (ANY,), len(host + path))


def unwanted(word: str) -> Rule:
    """Blocks hosts that have the word between dots or hyphens."""
    return Rule(None, "block", rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", (f"host:{word}",), len(word))


def _behind_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    words = F.transform(F.split(host, r"[.\-]"), lambda w: F.concat(F.lit("host:"), w))
    parts = F.transform(F.split(path, "/"), lambda w: F.concat(F.lit("path:"), w))
    return F.array_distinct(F.concat(words, parts, F.array(F.lit(ANY))))


def file_rules(rules: list[Rule], urls: DataFrame) -> DataFrame:
    """``token, name, verdict, pattern, size``: each rule under its token that the fewest rows of ``urls(tokens)`` have."""
    spark, few = urls.sparkSession, len(rules) <= BROADCAST_RULES
    asked = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    asked = F.broadcast(asked) if few else asked
    seen = urls.select(F.explode("tokens").alias("token")).join(asked, "token", "left_semi").groupBy("token").count()
    if few:
        # As many counts as the rules have tokens.
        common = {r["token"]: r["count"] for r in seen.collect()}
        rows = [(min(r.tokens, key=lambda t: (common.get(t, 0), t)), r.name, r.verdict, r.pattern, r.size) for r in rules]
        return F.broadcast(spark.createDataFrame(rows, "token string, name string, verdict string, pattern string, size int"))
    table = spark.createDataFrame(
        [(k, r.name, r.verdict, r.pattern, r.size, t) for k, r in enumerate(rules) for t in r.tokens],
        "rule int, name string, verdict string, pattern string, size int, token string",
    )
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")
    filed = table.join(seen, "token", "left").groupBy("rule", "name", "verdict", "pattern", "size").agg(rarest)
    return filed.drop("rule")


def judge_urls(df: DataFrame, key: str, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Every row's ``host, path, rule, verdict``.

    Listed rules win over the method's own (whose ``rule`` is null), the longest wins among them, and the
    alphabetically last among equally long ones. With no fitting rule the verdict is ``default``. Null
    URLs and those without ``://`` have an empty host and path and can fit only rules
    without tokens. Repeated rows and null keys stay; an empty table gives no rows; an
    empty list of rules gives the default everywhere. Other columns are not read.
    Rules meet URLs by token: no row is compared with all rules. The verdict is looked
    up by URL, so a URL that many rows share is judged once per task.
    """
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    out = [F.col("key").alias(key), "host", "path"]
    if not rules:
        return rows.select(*out, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = rows.select("host", "path", url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    index = file_rules(rules, urls)
    fits = (
        urls.select("host", "path", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.col("name").isNotNull().alias("listed"), "size", "name", "verdict")).alias("best"))
    )
    return rows.join(fits, ["host", "path"], "left").select(
        *out, F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
