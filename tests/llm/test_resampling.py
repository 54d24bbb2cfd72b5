"""Interning against dictionaries; weights, scores and the draw against the definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sedge.llm import resampling as R
from sedge.llm.interning import Spans, intern
from sedge.llm.queries import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def spans():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    return Spans(data, rng.integers(0, 2900, 9000), rng.integers(0, 90, 9000))


def test_hashes_and_checksums(spans):
    assert spans.hashes().tolist() == [xxhash.xxh64_intdigest(spans[k]) for k in range(9000)]
    picked = np.arange(5, 9000, 7)
    assert R.checksums(spans, picked).tolist() == [zlib.crc32(spans[k]) for k in picked]


@pytest.mark.parametrize("one_place", [False, True])
def test_equal_bytes_share_a_slot(spans, monkeypatch, one_place):
    if one_place:  # all hashes equal: only the comparison of bytes tells spans apart
        spans = Spans(spans.data, spans.at[:400], spans.size[:400])
        monkeypatch.setattr(Spans, "hashes", lambda self: np.zeros(len(self.at), np.uint64))
    slots, first, counts = intern(spans)
    want = Counter(spans[k] for k in range(len(spans.at)))
    assert len(first) == len(want) and [spans[k] for k in first[slots]] == [spans[k] for k in range(len(slots))]
    assert [want[spans[k]] for k in first] == counts.tolist()
    assert [len(x) for x in intern(Spans(spans.data, spans.at[:0], spans.size[:0]))] == [0, 0, 0]


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def answer(documents, items):
    found = [(k, *features(t)) for k, t in documents]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in items for b in features(x)[1])
    whole, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole + 10000) / ((s[b] + 1) * (aim + 10000))))
    rows = []
    for k, n, f in found:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0]))
    drawn = enough[: 5 * len(enough) // 100]
    ranks = Counter()
    for rank, r in enumerate(drawn, 1):
        ranks[r, rank] += 1
    out = []
    for r in rows:
        rank = next((k for (q, k), many in ranks.items() if q == r and many), None)
        ranks[r, rank] -= 1
        out.append((r[0], *r[2:], rank))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_query_against_the_definition(spark):
    found = registry.queries["op11_importance_resampling"](spark, SF)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {d for _, d in found.dtypes} == {"bigint"}
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    assert in_order(map(tuple, found.collect())) == in_order(answer(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")]))


@pytest.mark.parametrize("part", [7, R.PART_WORDS])
def test_parts_lose_no_gram(part):
    texts = [None, "", "One, two; THREE four\n" * 9, "a", "été-AéB x y", "- -", "1 2"]
    total = Counter()
    for bucket, counts, row, slots in R.gram_slots(pa.array(texts), 10000, part):
        assert np.bincount(slots).tolist() == counts.tolist()
        total.update(zip(row.tolist(), bucket[slots].tolist(), strict=True))
    assert total == Counter((k, b) for k, t in enumerate(texts) for b in features(t)[1])


def test_odd_rows(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcXYZé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(k, words(rng.randint(15, 40))) for k in range(150)] + [(7, "same text of a key " * 6)] * 60 + [(None, words(30))] * 3
    rows += [(900, None), (901, ""), (902, "?!"), (903, words(90_000)), (904, "w" * 70_000 + " " + words(25))]
    items = ["abc XYZ é", None, "", words(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rank int").repartition(4)
    target = spark.createDataFrame([(x,) for x in items], "text string")
    run = lambda d, t: R.resample(d, "doc_id", "text", t, "text").drop("n_words")
    assert in_order(map(tuple, run(df, target).collect())) == in_order(answer(rows, items))
    assert run(df.filter("false"), target).count() == 0
    assert in_order(map(tuple, run(df, target.filter("false")).collect())) == in_order(answer(rows, []))
    few = R.resample(df.selectExpr("cast(doc_id AS string) AS name", "text"), "name", "text", target, "text", percent=100)
    assert few.filter("rank is not null").count() == sum(features(t)[0] >= 20 for _, t in rows)
