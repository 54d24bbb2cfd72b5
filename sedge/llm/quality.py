"""Positive-unlabelled quality scores.

Some texts are trusted to be good; nothing is known of the rest of the web. A small network is
fitted to the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

where the class prior (the share of good texts among the unlabelled) is estimated first: a
plain classifier of trusted against unlabelled texts orders them, and over all thresholds the
smallest ratio "unlabelled above / trusted above", with a margin for chance, bounds the prior.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the fitting sample; everything else reads all rows.
TRUSTED_ROWS = 10_000
UNLABELLED_ROWS = 20_000

# Byte classes, in this order.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "comma", "mark", "bar", "quote", "high", "other")


def _byte_classes() -> np.ndarray:
    of = dict(zip(CLASSES, range(len(CLASSES)), strict=True))
    out = np.full(256, of["other"], np.uint8)
    for letters, name in ((b" \t\x0b\x0c\r", "space"), (b"\n", "line"), (b".", "stop"), (b",;:", "comma"), (b"!?", "mark"), (b"|", "bar"), (b"'\"()", "quote")):
        out[list(letters)] = of[name]
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = of["lower"], of["upper"], of["digit"]
    out[0x80:] = of["high"]
    return out


BYTE_CLASS = _byte_classes()
SPACE = np.isin(np.arange(len(CLASSES)), (3, 4))
SHAPES = ("log_bytes", "word_bytes", "long_words", "distinct_words", "common_words", "lines_again", "line_words", "tail_mark", "clean_words")
FEATURES = (*CLASSES, *SHAPES)


def text_features(text: str | None) -> list[float]:
    """Shares of byte classes, and word and line shapes; null and empty texts give zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    codes = BYTE_CLASS[np.frombuffer(raw, np.uint8)]
    shares = np.bincount(codes, minlength=len(CLASSES)) / len(raw)
    words = raw.split()
    n = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    times = Counter(words)
    top = nlargest(10, times.values())
    lines = raw.split(b"\n")
    # Where a word ends: on a letter, or on something else that is not plain punctuation.
    space = SPACE[codes]
    ends = codes[np.flatnonzero(space[1:] & ~space[:-1])] if space.any() else codes[-1:]
    if not len(ends):
        ends = codes[-1:]
    ends = np.bincount(ends, minlength=len(CLASSES)) / len(ends)
    return [
        *shares.tolist(),
        float(np.log1p(len(raw))),
        float(sizes.mean()),
        float((sizes > 14).mean()),
        len(times) / n,
        sum(top) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(ends[[7, 8, 9, 11]].sum()),
        float(ends[[0, 5, 6, 10]].sum()),
    ]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Net:
    """Standardised inputs, one hidden layer of tanh units and a skip connection."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]

    @classmethod
    def new(cls, x: np.ndarray, hidden: int, seed: int) -> "Net":
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        spread = x.std(0)
        parts = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(d), np.zeros(1)]
        return cls(x.mean(0), np.where(spread > 1e-9, spread, 1.0), parts)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, s, c = self.parts
        h = np.tanh(z @ w + b)
        return h @ v + z @ s + c[0], h

    def gradient(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        back = slope[:, None] * self.parts[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ slope, z.T @ slope, np.array([slope.sum()])]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.inputs(x))[0]


def descend(net: Net, slopes, z: np.ndarray, steps: int, rate: float, decay: float) -> Net:
    """Full-batch Adam; ``slopes(logits)`` gives the loss's derivative by logit."""
    first = [np.zeros_like(p) for p in net.parts]
    second = [np.zeros_like(p) for p in net.parts]
    for t in range(1, steps + 1):
        out, h = net.forward(z)
        for p, g, m, v in zip(net.parts, net.gradient(z, h, slopes(out)), first, second, strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(trusted: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """Share of good texts among the unlabelled, from scores of both (higher: more like trusted ones).

    For each threshold the unlabelled share above divided by the trusted share above bounds the prior
    from above; the threshold is chosen by the ratio plus a margin for chance.
    """
    cuts = np.unique(np.quantile(trusted, np.linspace(0, 0.99, 100)))
    above_t = np.array([(trusted >= c).mean() for c in cuts])
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(4 / chance) / 2) * (len(unlabelled) ** -0.5 + len(trusted) ** -0.5)
    at = int(np.argmin((above_u + margin) / above_t))
    return float(np.clip(above_u[at] / above_t[at], 0.05, 0.99))


def fit(trusted: np.ndarray, unlabelled: np.ndarray, hidden: int = 16, steps: int = 240, seed: int = 7) -> tuple[Net, float]:
    """The network and the estimated prior."""
    p, u = len(trusted), len(unlabelled)
    x = np.vstack([trusted, unlabelled])
    is_trusted = np.arange(p + u) < p
    weight = np.where(is_trusted, 0.5 / p, 0.5 / u)
    # The prior is read off rows that the ordering classifier was not fitted to.
    half = np.arange(p + u) % 2 == 0
    plain = Net.new(x[half], hidden, seed)
    descend(plain, lambda out: weight[half] * (sigmoid(out) - is_trusted[half]) * 2, plain.inputs(x[half]), steps // 2, 0.02, 1e-5)
    out = plain.logit(x[~half])
    prior = class_prior(out[is_trusted[~half]], out[~is_trusted[~half]])
    net = Net.new(x, hidden, seed + 1)

    def slopes(out: np.ndarray) -> np.ndarray:
        s = sigmoid(out)
        as_bad = np.logaddexp(0, out)  # loss of calling a text bad when its logit is high
        rest = as_bad[~is_trusted].mean() - prior * as_bad[is_trusted].mean()
        bad = np.where(is_trusted, -prior * s / p, s / u)
        good = np.where(is_trusted, prior * (s - 1) / p, 0.0)
        # A negative remainder is over-fitting: step back on it instead.
        return good + bad if rest >= 0 else -bad

    return descend(net, slopes, net.inputs(x), steps, 0.02, 1e-5), prior


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Keys of at most ``rows`` rows, those with the smallest hash."""
    return df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(rows)


def feature_rows(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """``key``, the other columns, and ``features``."""
    kept = [key, *others]
    types = dict(df.dtypes)

    def extract(batches):
        for batch in batches:
            values = [text_features(t) for t in batch.column(len(kept)).to_pylist()]
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.list_(pa.float64()))], names=[*kept, "features"])

    ddl = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return df.select(*kept, text).mapInArrow(extract, f"{ddl}, features array<double>")


def fit_quality(
    documents: DataFrame, trusted: DataFrame, key: str, text: str,
    trusted_rows: int = TRUSTED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
) -> tuple[Net, float] | None:
    """Fit on a bounded sample: ``trusted`` holds the keys of good texts; the unlabelled come from all documents.

    None when there is no trusted or no unlabelled text.
    """
    good = F.broadcast(hash_sample(trusted.filter(F.col(key).isNotNull()), key, trusted_rows).withColumn("_good", F.lit(True)))
    any_ = F.broadcast(hash_sample(documents.filter(F.col(key).isNotNull()), key, unlabelled_rows).withColumn("_any", F.lit(True)))
    sample = documents.select(key, text).join(good, key, "left").join(any_, key, "left").filter("_good or _any")
    rows = feature_rows(sample, key, text, "_good", "_any").orderBy(F.xxhash64(key), key).collect()
    p = np.array([r["features"] for r in rows if r["_good"]])
    u = np.array([r["features"] for r in rows if r["_any"]])
    return fit(p, u) if len(p) and len(u) else None


def is_good(text: str, model: tuple[Net, float] | None, at_least: float = 0.5) -> Column:
    """Whether a text's score reaches ``at_least``; without a model all texts do."""
    net = model[0] if model else None

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        if net is None:
            return pd.Series(np.ones(len(texts), bool))
        x = np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return pd.Series(sigmoid(net.logit(x)) >= at_least)

    return good(F.col(text))


def score_quality(df: DataFrame, key: str, text: str, model: tuple[Net, float] | None, held_out: Column) -> DataFrame:
    """``key, held_out, score, predicted`` of every row.

    Null and empty texts are scored by their (zero) features like any other. Without a model every score is 0.5.
    Repeated rows and null keys stay; an empty table gives no rows; other columns are not read.
    """
    net = model[0] if model else None

    def score(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            x = np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            values = sigmoid(net.logit(x)) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"],
            )

    rows = df.select(F.col(key), held_out.alias("held_out"), F.col(text).alias("_body"))
    return rows.mapInArrow(score, f"`{key}` {dict(df.dtypes)[key]}, held_out boolean, score double, predicted int")
