"""Toxicity by fuzzy lexicon search and context windows.

The lexicon (whole words and stems) is learned from labelled texts and kept as a trie. A
Levenshtein automaton run over the trie reads a word letter by letter; a set of (trie node,
edits) pairs is one state of the product automaton, and its transitions are worked out once and kept, so
a word costs one table look-up per letter until its state dies. Hits are scored within a window of
words: quotation and reporting words near a hit make it weaker, further hits and
direct address make it stronger. A logistic model over those sums gives the score.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.scratch import materialized

# Bounds of the fitting sample; everything else reads all rows.
TOXIC_ROWS = 3_000
CLEAN_ROWS = 6_000
LEAST_TEXTS = 4
LEAST_ODDS = 3.2
FALSE_TERMS = 0.05
STEM_LENGTHS = range(3, 11)
WINDOW = 8
CACHE_WORDS = 200_000
EDGE = "\"'“”„«»‘’‚‹›()[]{}<>.,;:!?…*_~`|/\\#&%$+=-–—"
# Words and marks that tell a quotation from abuse, and direct address; fixed values.
REPORTING = frozenset("said says wrote writes quoted quote called cited reported sagte schrieb zitiert dit écrit cité dijo escribió citado".split())
ADDRESS = frozenset("you your you're youre u du dein dich ihr euch tu toi ton vous votre tú te vosotros usted".split())
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"
FEATURES = ("exact", "fuzzy", "quoted", "kinds", "densest", "weight", "addressed", "share")


def edits_allowed(length: int) -> int:
    """Edits that still tell a term of this length: none below five letters, two from ten."""
    return 0 if length < 5 else 1 if length < 10 else 2


@dataclass
class Trie:
    """Terms by letter. ``ends[node]`` is the term's number; a stem's node accepts any rest."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    reach: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def of(cls, terms: Iterable[tuple[str, bool]]) -> "Trie":
        """From (term, is a stem) pairs."""
        trie = cls()
        for number, (term, stem) in enumerate(terms):
            node, allowed = 0, edits_allowed(len(term))
            trie.reach[0] = max(trie.reach[0], allowed)
            for letter in term:
                node = trie.children[node].setdefault(letter, len(trie.children))
                if node == len(trie.children):
                    trie.children.append({})
                    trie.reach.append(0)
                trie.reach[node] = max(trie.reach[node], allowed)
            trie.ends[node] = (number, allowed, stem)
        return trie


class FuzzyLexicon:
    """``hit(word)``: the (term, edits) with the fewest edits that the word spells, or None."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.trie = Trie.of(terms)
        self.alphabet = {c for node in self.trie.children for c in node}
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.pairs: list[frozenset] = []
        self.at_end: list[tuple[int, int] | None] = []
        self.at_once: list[tuple[int, int] | None] = []
        self.words: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({(0, 0)})

    def _skipping(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With letters of the lexicon left out of the word; of a node only the fewest edits stay."""
        fewest: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits > self.trie.reach[node] or fewest.get(node, 99) <= edits:
                continue
            fewest[node] = edits
            todo += [(child, edits + 1) for child in self.trie.children[node].values()]
        return frozenset(fewest.items())

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        closed = self._skipping(pairs)
        number = self.states.get(closed)
        if number is None:
            number = self.states[closed] = len(self.pairs)
            self.pairs.append(closed)
            self.moves.append({})
            found = [(edits, term, stem) for node, edits in closed if node in self.trie.ends for term, allowed, stem in [self.trie.ends[node]] if edits <= allowed]
            stems = [f for f in found if f[2]]
            self.at_end.append(min(found)[1::-1] if found else None)
            self.at_once.append(min(stems)[1::-1] if stems else None)
        return number

    def _move(self, state: int, letter: str) -> int:
        pairs = set()
        for node, edits in self.pairs[state]:
            pairs.add((node, edits + 1))
            for own, child in self.trie.children[node].items():
                pairs.add((child, edits + (own != letter)))
        return self._state(pairs)

    def walk(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for letter in word:
            known = self.moves[state]
            letter = letter if letter in self.alphabet else ""
            nxt = known.get(letter)
            if nxt is None:
                nxt = known[letter] = self._move(state, letter)
            state = nxt
            if not self.pairs[state]:
                return best
            early = self.at_once[state]
            if early and (best is None or early[1] < best[1]):
                best = early
        last = self.at_end[state]
        return last if last and (best is None or last[1] < best[1]) else best

    def hits(self, words: list[str]) -> list[tuple[int, tuple[int, int]]]:
        """Positions and (term, edits) of the words that spell a term."""
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = self.walk(word.strip(EDGE))
        return [(k, found) for k, w in enumerate(words) if (found := known[w])]


@lru_cache(maxsize=1)
def fuzzy_lexicon(terms: tuple[tuple[str, bool], ...]) -> FuzzyLexicon:
    """One automaton and cache for a worker process."""
    return FuzzyLexicon(terms)


def context_features(words: list[str], lexicon: FuzzyLexicon, weights: list[float]) -> list[float]:
    """Sums over a text's hits, each weakened or strengthened by its window."""
    found = lexicon.hits(words)
    if not found:
        return [0.0] * len(FEATURES)
    exact = fuzzy = quoted = addressed = weight = 0.0
    places = np.array([k for k, _ in found])
    near = np.searchsorted(places, places + WINDOW, "right") - np.searchsorted(places, places - WINDOW, "left")
    for k, (term, edits) in found:
        around = words[max(0, k - WINDOW) : k + WINDOW + 1]
        before, after = words[max(0, k - WINDOW) : k + 1], words[k : k + WINDOW + 1]
        is_quoted = bool(REPORTING.intersection(around)) or (
            any(w[0] in OPENING for w in before) and any(w.rstrip(".,;:!?")[-1:] in CLOSING and w.rstrip(".,;:!?") for w in after)
        )
        strength = 0.5 if edits else 1.0
        quoted += is_quoted
        exact += not edits
        fuzzy += bool(edits)
        addressed += bool(ADDRESS.intersection(around)) and not is_quoted
        weight += strength * weights[term] * (0.3 if is_quoted else 1.0)
    return [
        float(np.log1p(exact)), float(np.log1p(fuzzy)), quoted / len(found), float(np.log1p(len({t for _, (t, _) in found}))),
        float(np.log1p(near.max())), float(np.log1p(weight)), float(np.log1p(addressed)), float(np.log1p(100 * len(found) / len(words))),
    ]


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def stems_of(words: Iterable[str]) -> set[str]:
    """Distinct words and beginnings, marked by a star where the word goes on or may go on."""
    out = set()
    for word in {w.strip(EDGE) for w in words}:
        if len(word) >= STEM_LENGTHS.start:
            out.add(word)
            out.update(word[:n] + "*" for n in STEM_LENGTHS if len(word) >= n)
    return out


def _chance(t: int, c: int, share: float) -> float:
    """That of t + c texts, each toxic with chance ``share``, t or more are."""
    n = t + c
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(1 - share) + (n - i) * log(share) for i in range(c + 1)]
    return min(1.0, sum(map(exp, logs)))


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, tested: int) -> list[tuple[str, bool, float]]:
    """(term, is a stem, log odds) from (term, toxic texts, clean texts) counts.

    A term must be in four toxic texts, be about 25 times as frequent there as elsewhere, and be no work of chance: of the accepted
    terms one in twenty may be (Benjamini and Hochberg's rule, over all ``tested`` terms of four toxic texts). Of a word and
    its beginnings, the longest one that keeps nine tenths of the shortest one's texts stands for all.
    """

    def odds(t: int, c: int) -> float:
        return float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))

    share = toxic / (toxic + clean)
    likely = sorted((_chance(t, c, share), w, t, c) for w, t, c in counts if t >= LEAST_TEXTS and odds(t, c) > LEAST_ODDS)
    accepted = max((k for k, (p, *_) in enumerate(likely, 1) if p <= FALSE_TERMS * k / max(tested, 1)), default=0)
    good = {w: (t, c, odds(t, c)) for _, w, t, c in likely[:accepted]}
    by_length, by_name = sorted(good, key=lambda w: (len(w.rstrip("*")), w)), sorted(good)
    out, covered = [], set()
    for word in by_length:
        if word in covered:
            continue
        best, texts = word, good[word][0]
        if word.endswith("*"):
            family = by_name[bisect_left(by_name, word[:-1]) : bisect_left(by_name, word[:-1] + chr(0x10FFFF))]
            covered.update(family)
            for w in family:
                if good[w][0] >= 0.9 * texts and len(w.rstrip("*")) >= len(best.rstrip("*")):
                    best = w
        out.append((best.rstrip("*"), best.endswith("*"), good[best][2], good[best][0]))
    out.sort(key=lambda x: (-x[3] * x[2], x[0], x[1]))
    return [x[:3] for x in out]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients and intercept by damped Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    beta, weight = np.zeros(z.shape[1]), weight / weight.sum()
    for _ in range(steps):
        p = _sigmoid(z @ beta)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), z.T @ (weight * (p - y)) + ridge * beta)
        beta -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass(frozen=True)
class ToxicModel:
    terms: tuple[tuple[str, bool, float], ...]
    beta: tuple[float, ...]

    def scorer(self):
        lexicon = fuzzy_lexicon(tuple(t[:2] for t in self.terms))
        weights, beta = [t[2] for t in self.terms], np.array(self.beta)

        def score(texts: list[str | None]) -> np.ndarray:
            x = np.array([context_features(words_of(t), lexicon, weights) for t in texts]).reshape(len(texts), len(FEATURES))
            return _sigmoid(x @ beta[:-1] + beta[-1])

        return score


def _term_counts(rows: DataFrame, text: str) -> DataFrame:
    """Texts per term and class; each task sums what it reads first."""

    def count(batches):
        totals: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for body, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[int(label)].update(stems_of(words_of(body)))
        clean, toxic = totals
        terms = list(toxic.keys() | clean.keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([toxic[w] for w in part], pa.int64()), pa.array([clean[w] for w in part], pa.int64())],
                names=["term", "toxic", "clean"],
            )

    counted = rows.select(F.col(text), F.col("label")).mapInArrow(count, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _digest(text: str) -> Column:
    """Of the whole text, without case and with any white space as one blank; null is empty."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))))


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, key: str, text: str, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS
) -> ToxicModel | None:
    """Lexicon and score from at most ``toxic_rows`` and ``clean_rows`` different labelled texts (those whose keys have the
    smallest hashes). ``labels`` has the key and a 0/1 ``label``. None when a class has no text.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col("label").isin(0, 1)).select(key, F.col("label").cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # Copies would pass off their rare words as common ones: of equal texts of a label the smallest key stands for all.
    equal = documents.select(key, _digest(text).alias("_digest")).join(known, key)
    firsts = materialized(equal.groupBy("label", "_digest").agg(F.min(key).alias(key)), "distinct-labelled")
    drawn = [firsts.filter(f"label = {label}").orderBy(F.xxhash64(key), key).limit(most) for label, most in ((1, toxic_rows), (0, clean_rows))]
    texts = documents.select(key, text).join(F.broadcast(drawn[0].unionByName(drawn[1])), key).filter(_digest(text) == F.col("_digest"))
    # A bounded number of texts, read twice.
    rows = materialized(texts.dropDuplicates(["label", "_digest"]).select(text, "label"), "labelled")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    counts = materialized(_term_counts(rows, text).filter(F.col("toxic") >= LEAST_TEXTS), "term-counts")
    # Of a bounded sample's terms, those that tell toxic texts from others.
    telling = (F.col("toxic") + 0.5) * (sizes[0] + 1) > (F.col("clean") + 0.5) * (sizes[1] + 1) * float(np.exp(LEAST_ODDS))
    terms = choose_terms([tuple(r) for r in counts.filter(telling).collect()], sizes[1], sizes[0], counts.count())
    lexicon_terms, weights = tuple(t[:2] for t in terms), [t[2] for t in terms]

    def features(batches):
        lexicon = fuzzy_lexicon(lexicon_terms)
        for batch in batches:
            values = [context_features(words_of(t), lexicon, weights) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["features", "label"])

    found = rows.select(text, "label").mapInArrow(features, "features array<double>, label int").collect()
    found.sort(key=lambda r: (r["label"], r["features"]))
    x, y = np.array([r["features"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found])
    if not len(y) or y.min() == y.max():
        return None
    # The sample's classes count as they do among all labelled rows.
    share = np.array([totals[0] / max((y == 0).sum(), 1), totals[1] / max((y == 1).sum(), 1)])
    return ToxicModel(tuple(terms), tuple(logistic(x, y.astype(float), share[y]).tolist()))


def score_toxicity(df: DataFrame, key: str, text: str, model: ToxicModel | None, held_out: Column, at_least: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` of every row and its whole text.

    Null and empty texts have no hit and get the score of a text without hits; without a model
    every score is 0. Repeated rows and null keys stay; an empty table gives no rows; other columns are not read.
    """

    def score(batches):
        of = model.scorer() if model else lambda texts: np.zeros(len(texts))
        for batch in batches:
            values = of(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= at_least).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"],
            )

    rows = df.select(F.col(key), held_out.alias("held_out"), F.col(text).alias("_body"))
    return rows.mapInArrow(score, f"`{key}` {dict(df.dtypes)[key]}, held_out boolean, score double, predicted int")
