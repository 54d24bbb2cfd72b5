"""Near duplicates against brute force, whatever counts as a common block."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sedge.llm import graph, hashing, near


def words(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return (text or "").encode().translate(low).split()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    links = [
        (a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    label = smallest({k for k, _ in sets}, links)
    return sorted(((k, len(shingles(t)), label.get(k)) for k, t in rows), key=repr)


def corpus(seed, families=12, copies=25):
    """Families of edited copies, passages shared by many texts, short texts, and loners."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    passage, out = text(40), []
    for _ in range(families):
        base = text(rng.choice([3, 5, 6, 9, 20, 60, 150, 400]))
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.2:
                own = own[: max(1, int(len(own) * rng.uniform(0.7, 1)))]
            out.append(own)
    out += [text(rng.randint(5, 30)) + passage + text(rng.randint(0, 60)) for _ in range(40)]
    out += [text(rng.randint(1, 80)) for _ in range(30)]
    rng.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("seed", "few"), [(1, 16), (2, 4), (3, 2), (4, 1)])
def test_same_as_brute_force(spark, monkeypatch, seed, few):
    # FEW travels with the functions' code to local workers, so set it in the environment of the module.
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "TASK_ENTRIES", 5)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, near.near_duplicates(df, "doc_id", "text", ).collect()), key=repr)
    assert got == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [
        (5, "A b C d e f"), (4, "a B c d e f"), (4, "a B c d e f"), (9, None), (8, ""), (7, " \t\n"), (6, "one two"), (3, "ONE  two"), (2, "one two three"),
        (None, "a b c d e f"), (None, "a b c d e f"), (1, long), (0, long + " more"), (12, "É x"), (11, "é x"), (13, "x" * 3_000_000), (10, "a b"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, c int, n int").repartition(4)
    got = sorted(map(tuple, near.near_duplicates(df, "doc_id", "text").collect()), key=repr)
    assert got == brute(rows)
    kept = near.one_of_each(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [0, 2, 3, 4, 4, 7, 8, 9, 10, 11, 12, 13]
    assert near.near_duplicates(df.filter("false"), "doc_id", "text").count() == 0
    with pytest.raises(ValueError, match="80 percent"):
        near.near_duplicates(df, "doc_id", "text", 70)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 1 << 63, rng.integers(0, 300), dtype=np.uint64)]) for _ in range(2))
        assert near.least_difference(near.sketch(a), near.sketch(b)) <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_block():
    rng = np.random.default_rng(6)
    for _ in range(300):
        size = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, size // 4)))):
            b = b[1:] if rng.random() < 0.5 and len(b) > 1 else np.unique(np.r_[b, rng.integers(0, 1 << 63, 1, dtype=np.uint64)])
        if not near.linked(a, b, 80):
            continue
        own, other = ({int(x) for _, values in near.set_signatures(s) for x in values} for s in (a, b))
        if min(margin for s in (a, b) for margin, _ in near.set_signatures(s)) > 0:
            assert own & other


def test_word_hashes_in_slices(monkeypatch):
    texts = pa.array(["", None, "a b", "  x" * 40 + "y" * 300 + " " + "z" * 200 + " q", "word", "É é Ûx ûX a", " ", "a b c d e f", "A,b;C"])
    for alphabet in (hashing.WHITE_SPACE, hashing.LETTERS):
        whole = hashing.word_hashes(texts, alphabet)
        monkeypatch.setattr(hashing, "SLICE_BYTES", 16)
        cut = hashing.word_hashes(texts, alphabet)
        monkeypatch.setattr(hashing, "SLICE_BYTES", 1 << 20)
        assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    counts = np.diff(hashing.word_hashes(texts, hashing.WHITE_SPACE)[1]).tolist()
    assert counts == [len(words(t)) for t in texts.to_pylist()]
    part = texts.slice(2, 4)
    assert np.diff(hashing.word_hashes(part, hashing.WHITE_SPACE)[1]).tolist() == counts[2:6]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(300, 325)] + [(500, k) for k in range(501, 540)] + [(7, 7), (600, 600)]
    got = dict(map(tuple, graph.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()))
    assert got == smallest({n for link in links for n in link}, links)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
