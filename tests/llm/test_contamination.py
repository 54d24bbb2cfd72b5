"""Copies of test items: planted exact, edited and reordered ones, and alignment against the plain recursion."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sedge.llm import contamination as C
from sedge.llm.hashing import LETTERS, runs_of, word_hashes


def plain_score(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (C.MATCH if x == y else C.MISMATCH), last[j + 1] - C.GAP, row[j] - C.GAP))
        best, last = max(best, *row), row
    return best


def test_alignment_scores():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64)) for _ in range(120)]
    score, _, _ = C.align([a for a, _ in pairs], [b for _, b in pairs])
    assert score.tolist() == [plain_score(a.tolist(), b.tolist()) for a, b in pairs]
    for (a, b), (s, first, end) in zip(pairs, C._aligned([a for a, _ in pairs], [b for _, b in pairs]).tolist(), strict=True):
        assert plain_score(a.tolist(), b[first:end].tolist()) == s


def make(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = {k: text(rng.randint(12, 50)) for k in range(20)}
    documents, want = {}, set()
    for k in range(200):
        own = text(rng.randint(0, 120))
        kind = rng.choice(["none", "exact", "edited", "shortened", "case", "long"])
        item = rng.choice(list(items))
        copy = list(items[item])
        if kind == "edited":
            for at in rng.sample(range(len(copy)), len(copy) // 8):
                copy[at] = word()
            copy.insert(rng.randrange(len(copy)), word())
        if kind == "shortened":
            copy = copy[: -(len(copy) // 5)]
        if kind == "case":
            copy = [w.upper() + "," for w in copy]
        if kind == "long":
            own += text(20_000)
        if kind not in ("none",):
            at = rng.randint(0, len(own))
            own = own[:at] + copy + own[at:]
            want.add((k, item))
        documents[k] = " ".join(own)
    return items, documents, want


def test_planted_copies(spark, monkeypatch):
    items, documents, want = make()
    df = spark.createDataFrame(list(documents.items()), "doc_id long, text string").repartition(4)
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = C.contaminated(df, "doc_id", "text", tests, "item_id", "text").collect()
    assert {(r["doc_id"], r["item"]) for r in found} == want
    for r in found:
        held = documents[r["doc_id"]].lower().replace(",", "").split()[r["first_word"] : r["end_word"]]
        assert plain_score(items[r["item"]], held) / (2 * len(items[r["item"]])) == pytest.approx(r["score"])
    monkeypatch.setattr(C, "BIT_TABLE", 8)  # nearly every bit is set: all is left to the joins
    cut = C.contaminated(df, "doc_id", "text", tests, "item_id", "text").collect()
    assert {(r["doc_id"], r["item"]) for r in cut} == want


@pytest.mark.parametrize("part", [1, 3, 7, 1000])
def test_parts_lose_no_seed(part):
    texts = ["a b c d e f", None, "", "x", "a b", "c a b b c a"]
    every = np.full(1 << (C.BIT_TABLE - 6), ~np.uint64(0))
    rows = sorted((r, p, g) for x in C._seed_places(pa.array(texts), every, [1, 2, 3], part) for r, p, g in zip(*(y.tolist() for y in x), strict=True))
    want = []
    for k, t in enumerate(texts):
        words = word_hashes(pa.array([t], pa.string()), LETTERS)[0]
        for n in (1, 2, 3):
            want += [(k, at, int(runs_of(words[at : at + n], n)[0])) for at in range(len(words) - n + 1)]
        want += [(k, at, int(runs_of(words[[at, at + 2]], 2)[0])) for at in range(len(words) - 2)]
    assert rows == sorted(want)


def test_copies_edited_throughout_against_plain_alignment(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 4)))
    items = {k: [word() for _ in range(rng.randint(4, 30))] for k in range(12)}
    documents = {}
    for k in range(240):
        own = list(items[k % 12])
        if k % 5 < 3:
            own = [word() if at % (k % 5 + 3) == k % 3 else w for at, w in enumerate(own)]
        if k % 5 == 3:
            own = [w for x in own for w in (x, word())]
        if k % 5 == 4:
            own = [w for w in own if rng.random() < 0.75]
        documents[k] = [word() for _ in range(k % 7)] + own + [word() for _ in range(k % 4)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in documents.items()], "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item"]) for r in C.contaminated(df, "doc_id", "text", tests, "item_id", "text").collect()}
    assert found == {(d, i) for d, ws in documents.items() for i, own in items.items() if plain_score(own, ws) >= len(own)}


def test_common_copies_are_found_all_the_same(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.range(300).selectExpr("id AS doc_id", f"concat('x', id, ' {item} y', id) AS text")
    tests = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert C.contaminated(df, "doc_id", "text", tests, "item_id", "text").count() == 300


def test_odd_rows(spark):
    item = "one two three four five six seven eight"
    rows = [(1, None, 9), (2, "", 9), (3, "!!! ...", 9), (4, item, 9), (4, item, 9), (None, item, 9), (5, ("z " * 50_000) + item, 9), (6, "solo", 9), (7, "É à", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item int").repartition(2)
    tests = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "solo"), (None, "é À")], "item_id int, text string")
    got = sorted(((r["doc_id"], r["item"], r["score"]) for r in C.contaminated(df, "doc_id", "text", tests, "item_id", "text").collect()), key=repr)
    assert got == sorted([(k, 1, 1.0) for k in (4, 4, None, 5) for _ in range(2)] + [(6, 4, 1.0), (7, None, 1.0)], key=repr)
    assert C.contaminated(df.filter("false"), "doc_id", "text", tests, "item_id", "text").count() == 0
    assert C.contaminated(df, "doc_id", "text", tests.filter("false"), "item_id", "text").count() == 0


def test_common_pairs_are_left_out_and_nothing_is_lost(spark):
    """Many items share their most frequent pairs, which also fill one long text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    items = {k: ["of", "the"] + [word() for _ in range(10)] + ["of", "the"] + [word() for _ in range(8)] for k in range(40)}
    documents = {1: ["of", "the"] * 6000 + items[7] + ["of", "the"] * 3000, 2: ["of", "the", "of"] * 20, 3: items[9][::2] + ["of", "the"] * 50}
    documents[4] = [w if at % 4 else word() for at, w in enumerate(items[11])]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in documents.items()], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item"]) for r in C.contaminated(df, "doc_id", "text", tests, "item_id", "text").collect()}
    assert found == {(1, 7), (4, 11)} and all(plain_score(items[i], documents[d]) >= len(items[i]) for d, i in found)
    assert plain_score(items[9], documents[3]) < len(items[9])
    known = C._item_words(tests, "text")
    kept = C._item_seeds(known, 0.5)
    assert kept.count() == sum(len(w) - 1 for w in items.values())


def test_rows_go_by_their_text(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, "x " + item, 1), (1, item + " y", 2), (1, "clean text of the same key", 3), (None, "clean text without a key", 4), (2, None, 5), (2, None, 5), (3, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d1 int")
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = C.uncontaminated(df, "text", tests, "text")
    assert left.columns == df.columns and sorted(r["d1"] for r in left.collect()) == [3, 4, 5, 5, 6]
    assert C.uncontaminated(df, "text", tests.filter("false"), "text").count() == 7
    assert C.uncontaminated(df.filter("false"), "text", tests, "text").count() == 0
