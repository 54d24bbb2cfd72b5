"""Masked pseudo-likelihood of texts under a bidirectional window network.

The network sees a word's left and right neighbour and predicts the word between them. Words are the most frequent ones of
the whole corpus, and shapes (length, last letter) for all others, so there are ``V`` classes in all. The
corpus enters the training as counts of (left, word, right), a table of V**3 cells at
most, summed over every document; each training step is a full pass over that table.
Within its shape a word has the probability of its count in the whole corpus; these counts are a table of one
row per distinct word. A text's score is the sum of its words' conditional log-probabilities,
log P(class | neighbours' classes) + log P(word | class).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.hashing import WHITE_SPACE, mix, words_of
from sedge.llm.scratch import materialized

FREQUENT = 115
SIZES = (2, 4, 6, 8, 11)
SHAPES = 2 * (len(SIZES) + 1)
EDGE = 0
# Words counted at least as often as the first power of two that leaves so many go to all tasks; the others' counts are joined.
COMMON_WORDS = 100_000


def _shapes(sizes: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    letter = (lasts >= 0x80) | ((lasts | 0x20) - ord("a") < 26)
    return 2 * np.searchsorted(SIZES, sizes) + letter


@dataclass(frozen=True)
class Classes:
    """Class 0 is a text's edge, then come the frequent words by hash, then the shapes."""

    frequent: np.ndarray

    @property
    def number(self) -> int:
        return 1 + len(self.frequent) + SHAPES

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all words, and for each row the number of words before it."""
        _, out, begins = self.words(column)
        return out, begins

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``of``, behind the words' hashes."""
        hashes, begins, sizes, lasts = words_of(column, WHITE_SPACE)
        out = 1 + len(self.frequent) + _shapes(sizes, lasts)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == hashes, at + 1, out)
        return hashes, out, begins

    def cells(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(left, word, right) of every word as one number."""
        word, begins = self.of(column)
        return self.windows(word, begins), begins

    def windows(self, word: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The numbers of ``cells`` from the words' classes."""
        left, right = np.empty_like(word), np.empty_like(word)
        if len(word):
            left[1:], right[:-1] = word[:-1], word[1:]
            first, behind = begins[:-1][np.diff(begins) > 0], begins[1:][np.diff(begins) > 0]
            left[first], right[behind - 1] = EDGE, EDGE
        v = self.number
        return (left * v + word) * v + right


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, shape, n``: every distinct word of all texts by hash, and how often it occurs; written once."""

    def count(batches):
        for batch in batches:
            hashes, _, sizes, lasts = words_of(batch.column(0), WHITE_SPACE)
            words, first, n = np.unique(hashes, return_index=True, return_counts=True)
            shape = _shapes(sizes[first], lasts[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "shape", "n"]
            )

    counted = df.select(text).mapInArrow(count, "word long, shape int, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    return materialized(counted, "words")


def frequent_words(df: DataFrame, text: str, most: int = FREQUENT, words: DataFrame | None = None) -> Classes:
    """The most frequent words of all texts; equally frequent ones by hash. ``words`` are the table's ``word_counts``, if they are there."""
    counts = word_counts(df, text) if words is None else words
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]
    return Classes(np.sort(np.array(top, np.int64).view(np.uint64)))


def neighbour_counts(df: DataFrame, text: str, classes: Classes) -> np.ndarray:
    """Counts over all texts, as an array (left, word, right)."""
    v = classes.number

    def count(batches):
        total = np.zeros(v**3, np.int64)
        for batch in batches:
            total += np.bincount(classes.cells(batch.column(0))[0], minlength=len(total))
        used = np.flatnonzero(total)
        for k in range(0, len(used), 100_000):
            part = used[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])

    cells = df.select(text).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # V**3 rows at most, whatever the corpus.
    rows = cells.toArrow()
    out = np.zeros(v**3, np.float64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(v, v, v)


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x - x.max(-1, keepdims=True)
    return top - np.log(np.exp(top).sum(-1, keepdims=True))


@dataclass
class WindowNet:
    """tanh units over the sum of a left and a right embedding; a softmax over the words."""

    left: np.ndarray
    right: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, counts: np.ndarray, units: int, seed: int) -> "WindowNet":
        rng, v = np.random.default_rng(seed), len(counts)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        words = counts.sum((0, 2)) + 0.5
        return cls(draw(v, units), draw(v, units), np.zeros(units, np.float32), draw(units, v) / 3, np.log(words / words.sum()).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.left, self.right, self.inner, self.out, self.bias]

    def hidden(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.tanh(self.left[left] + self.right[right] + self.inner)

    def log_probabilities(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of every word between the given neighbours."""
        return log_softmax(self.hidden(left, right) @ self.out + self.bias)

    def table(self) -> np.ndarray:
        """(left, word, right): the network's answers to all windows."""
        v = len(self.bias)
        left, right = (x.reshape(-1) for x in np.meshgrid(np.arange(v), np.arange(v), indexing="ij"))
        return np.ascontiguousarray(self.log_probabilities(left, right).reshape(v, v, v).transpose(0, 2, 1)).astype(np.float32)


def train(counts: np.ndarray, units: int = 32, steps: int = 160, rate: float = 0.03, seed: int = 11) -> WindowNet:
    """Adam on the mean negative log-probability of all counted words."""
    net = WindowNet.new(counts, units, seed)
    v = len(counts)
    seen = counts.transpose(0, 2, 1).reshape(v * v, v)
    window = np.flatnonzero(seen.sum(1))
    if not len(window):
        return net
    left, right = np.divmod(window, v)
    target = (seen[window] / seen.sum()).astype(np.float32)
    mass = target.sum(1, keepdims=True)
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    for t in range(1, steps + 1):
        hidden = net.hidden(left, right)
        slope = np.exp(log_softmax(hidden @ net.out + net.bias)) * mass - target
        back = (slope @ net.out.T) * (1 - hidden * hidden)
        at_left, at_right = np.zeros_like(net.left), np.zeros_like(net.right)
        np.add.at(at_left, left, back)
        np.add.at(at_right, right, back)
        slopes = [at_left, at_right, back.sum(0), hidden.T @ slope, slope.sum(0)]
        pace = rate * (1 - 0.9 * t / steps)
        for p, g, m, s in zip(net.parts(), slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= (pace * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit_pseudo_likelihood(df: DataFrame, text: str, frequent: int = FREQUENT, words: DataFrame | None = None) -> tuple[Classes, WindowNet]:
    """Classes and network from all texts of the table."""
    classes = frequent_words(df, text, frequent, words)
    return classes, train(neighbour_counts(df, text, classes))


@dataclass(frozen=True)
class WordShares:
    """For log P(word | shape): the logarithm of each shape's total, and of the counts of the common words by hash.

    Each shape counts one occurrence more than it has, which all words that the corpus lacks share.
    """

    totals: np.ndarray
    common: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, words: DataFrame, classes: Classes, most: int) -> tuple["WordShares", DataFrame]:
        """And the table of the other words' counts."""
        rest = words.filter(~F.col("word").isin(classes.frequent.view(np.int64).tolist()))
        totals = np.zeros(SHAPES)
        power = F.length(F.bin("n"))
        powers: Counter[int] = Counter()
        for r in rest.groupBy("shape", power.alias("power")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
            totals[r["shape"]] += r["n"]
            powers[r["power"]] += r["words"]
        least, sent = 64, 0
        while least > 1 and sent + powers[least - 1] <= most:
            least -= 1
            sent += powers[least]
        common = rest.filter(power >= least).select("word", "n").toArrow()
        hashes = common.column("word").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        return cls(np.log(totals + 1), hashes[order], np.log(common.column("n").to_numpy().astype(float))[order]), rest.filter(power < least).select("word", "n")

    def add(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | shape) but for the counts of the words that are not common, and which those are."""
        out = -self.totals[shapes]
        if not len(self.common):
            return out, np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        known = self.common[at] == hashes
        return out + np.where(known, self.logs[at], 0.0), ~known


def score_texts(
    df: DataFrame, key: str, text: str, model: tuple[Classes, WindowNet], words: DataFrame | None = None, common: int = COMMON_WORDS
) -> DataFrame:
    """``key, n_words, log_likelihood, per_word`` of every row and its whole text.

    ``words`` are the ``word_counts`` of the corpus; without them the sums are over classes, and words of one shape are alike.
    Null, empty and wordless texts have 0 words, a sum of 0 and a null mean. Repeated rows and null keys stay; an empty
    table gives no rows; other columns are not read. Tasks get the network's answers to all V * V windows, 8 MB or so, and the
    counts of at most ``common`` words; all other words meet their counts in a join.
    """
    classes, net = model
    shares, rare = WordShares.of(words, classes, common) if words is not None else (None, None)
    sent = df.sparkSession.sparkContext.broadcast((classes, net.table().reshape(-1), shares))

    def score(batches):
        own, answers, by_word = sent.value
        for batch in batches:
            hashes, word, begins = own.words(batch.column(2))
            logs = answers[own.windows(word, begins)].astype(np.float64)
            rows, n = batch.column(0).to_numpy(), np.diff(begins)
            text_of, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            left = np.zeros(0, np.uint64)
            if by_word is not None:
                shaped = np.flatnonzero(word > len(own.frequent))
                more, joined = by_word.add(hashes[shaped], word[shaped] - 1 - len(own.frequent))
                logs[shaped] += more
                at = shaped[joined]
                left, text_of = hashes[at], np.searchsorted(begins, at, "right") - 1
                order = np.lexsort((left, text_of))
                left, text_of = left[order], text_of[order]
                first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (text_of[1:] != text_of[:-1])])[: len(left)])
                times = np.diff(np.append(first, len(left)))
                left, text_of = left[first], text_of[first]
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            total = np.where(n > 0, sums[begins[1:]] - sums[begins[:-1]], 0.0)
            nothing = len(left)
            # A row of its own for each text, dealt by any number, and one for each word that waits for its count.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[text_of]])),
                    pa.concat_arrays([batch.column(1), pa.nulls(nothing, batch.column(1).type)]),
                    pa.array(np.concatenate([n, np.zeros(nothing, np.int64)])),
                    pa.array(np.concatenate([total, np.zeros(nothing)])),
                    pa.array(np.concatenate([mix(rows.astype(np.uint64)), left]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(rows), np.int64), times])),
                ],
                names=["_row", key, "n_words", "_sum", "word", "_times"],
            )

    body = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.col(text).alias("_body"))
    parts = body.mapInArrow(score, f"_row long, `{key}` {dict(df.dtypes)[key]}, n_words long, _sum double, word long, _times long")
    if rare is None:
        summed = parts.withColumnRenamed("_sum", "log_likelihood")
    else:
        logs = F.col("_sum") + F.col("_times") * F.log(F.coalesce("n", F.lit(1)).cast("double"))
        summed = parts.join(rare, "word", "left").groupBy("_row").agg(
            F.first(key, ignorenulls=True).alias(key), F.sum("n_words").alias("n_words"), F.sum(logs).alias("log_likelihood")
        )
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word")
    return summed.select(key, "n_words", "log_likelihood", mean)
