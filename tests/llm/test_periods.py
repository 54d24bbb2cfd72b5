"""Runs and Lyndon words against plain loops, on letters, texts and the whole smallest table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sedge.llm import periods as P
from sedge.llm.queries import registry

SF = "/root/testdata/sf0.001"


def plain_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, times * q) and not any(w[s : s + size - d] == w[s + d : s + size] for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 60))]
    if rng.random() < 0.6:
        a, p = rng.randrange(len(w)), rng.randint(1, 9)
        w = [w[i] if i < a else w[a + (i - a) % min(p, len(w) - a)] for i in range(len(w))]
    return w


def test_lyndon_words_and_runs():
    rng = random.Random(1)
    for _ in range(600):
        w = random_words(rng)
        used = sorted(set(w))
        for order in (used, used[::-1]):
            letters = [order.index(x) for x in w]
            assert P.lyndon_lengths(letters, len(used)) == plain_lyndon(letters)
        for least, times in ((24, 3), (2, 2), (5, 3), (6, 4)):
            assert P.runs_in(np.array(w, np.uint64), least, times) == plain_runs(w, least, times)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (8, 3), (2, 2), (10, 5)])
def test_stretches_lose_no_run(least, times):
    rng = random.Random(2)
    texts = [random_words(rng) for _ in range(400)]
    column = pa.array([" ".join(map(str, w)) if k % 7 else None for k, w in enumerate(texts)])
    counts, found = P.text_runs(column, least, times)
    for k, w in enumerate(texts):
        assert found.get(k, []) == (plain_runs(w, least, times) if k % 7 else [])
        assert counts[k] == (len(w) if k % 7 else 0)


def answer(doc_id, text):
    """The query's row by the definition alone."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), 1
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *tail, digest("".join(f"{s},{z},{q}\n" for s, z, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_the_definition(spark):
    found = registry.queries["op13_periodic_runs"](spark, SF)
    assert found.columns == COLUMNS
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, found.collect())) == sorted(answer(*d) for d in docs)


def test_odd_rows(spark, tmp_path):
    lines = "a b c d e f g h " * 5
    rows = [
        (10, None, 1), (11, "", 1), (12, " \t\n\x0b\x0c\r ", 1), (None, lines, 1), (13, lines + "x " + lines, 1), (13, lines, 1), (13, lines, 1),
        (14, "x y " * 1_500, 1), (15, "X x " * 20, 1), (16, "z" * 100_000, 1), (17, "  é   " * 12, 1), (18, "one", 1),
        (19, " ".join(random.Random(3).choices("abcdefgh", k=900)), 1), (33, lines, 1), (35, "q " * 200, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries["op13_periodic_runs"](spark, str(tmp_path))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted((answer(k, t) for k, t, _ in rows), key=key)
    empty = P.periodic_runs(df.filter("false"), "doc_id", "text")
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.count() == 0
    with pytest.raises(ValueError, match="two periods"):
        P.periodic_runs(df, "doc_id", "text", times=1)


def test_collapsed_text(spark):
    df = spark.createDataFrame([("k", "Go  on " + "and on " * 12 + "then stop")], "name string, body string")
    (row,) = P.periodic_runs(df, "name", "body").collect()
    assert row["collapsed"] == "Go on and then stop" and [tuple(r) for r in row["runs"]] == [(1, 25, 2)] and row["n_words"] == 28
