"""Packing: exact places, few sequences, and the linear program's parts against brute force."""

import itertools
import zlib

import numpy as np
import pytest

from sedge.llm import packing as P
from sedge.llm.tokens import WordTokens, vocabulary_path


def check_plan(demand, plan):
    limit = len(demand) - 1
    held = np.zeros(limit + 1, int)
    for content, count in plan:
        assert 0 < sum(content) <= limit and count > 0
        for length in content:
            held[length] += count
    assert (held == demand).all()
    return sum(count for _, count in plan)


def test_knapsack_table():
    rng = np.random.default_rng(3)
    for _ in range(30):
        weights = np.r_[0, np.where(rng.random(9) < 0.3, 0, rng.random(9))]
        best, last = P.prices_table(weights)
        for room in range(10):
            want = max(sum(weights[x] for x in c) for n in range(room + 1) for c in itertools.combinations_with_replacement(range(1, 10), n) if sum(c) <= room) if room else 0
            assert best[room] == pytest.approx(want)
            assert sum(P.filling(last, room)) <= room and sum(weights[x] for x in P.filling(last, room)) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_the_demand(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(1, 120))
    demand = rng.integers(0, 40, limit + 1) * (rng.random(limit + 1) < 0.5)
    demand[0] = 0
    n = check_plan(demand, P.packing_plan(demand))
    total = int((np.arange(limit + 1) * demand).sum())
    first_fit = 0
    rooms = []
    for length in np.repeat(np.arange(limit + 1), demand)[::-1].tolist():
        at = next((k for k, r in enumerate(rooms) if r >= length), None)
        if at is None:
            rooms.append(limit - length)
        else:
            rooms[at] -= length
    first_fit = len(rooms)
    assert -(-total // limit) <= n <= first_fit * 1.03 + 1


def test_best_fit_by_counts_is_best_fit():
    rng = np.random.default_rng(9)
    for _ in range(40):
        limit = int(rng.integers(3, 30))
        demand = np.r_[0, rng.integers(0, 6, limit)]
        rooms = []
        for length in np.repeat(np.arange(limit + 1), demand)[::-1].tolist():
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(limit - length)
        assert check_plan(demand, P.best_fit_counts(demand)) == len(rooms)


def test_perfect_partners_fill_all():
    demand = np.zeros(101, int)
    demand[[70, 30, 55, 45, 100]] = [500, 500, 300, 300, 7]
    assert check_plan(demand, P.packing_plan(demand)) == 807


def packed_rows(df, limit, **more):
    return P.pack(df, "doc_id", "text", vocabulary_path(), limit, **more).collect()


def test_pieces_and_places(spark):
    rows = [(1, "the cat sat " * 40, 5), (2, "", 5), (3, None, 5), (4, "a", 5), (4, "a", 5), (None, "no key here", 5), (6, "dog " * 15, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    tokens = WordTokens(vocabulary_path())
    for limit in (1, 4, 16, 2048):
        got = packed_rows(df, limit, with_ids=True)
        by_place = {}
        for r in got:
            by_place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        for parts in by_place.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= limit
        for key, text, _ in rows:
            whole = tokens.encode(text) + bytes(4)
            own = [r for r in got if r["doc_id"] == key]
            copies = sum(k == key for k, _, _ in rows)
            assert len(own) == copies * -(-len(whole) // (4 * limit))
            for r in own:
                assert r["start"] == r["piece"] * limit
                assert bytes(r["ids"]) == whole[4 * r["start"] : 4 * (r["start"] + limit)]


def test_empty_table(spark):
    assert packed_rows(spark.createDataFrame([], "doc_id long, text string"), 8) == []


def test_documents_reach_the_least_number(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packed_rows(docs, 2048)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= 1.005 * -(-total // 2048) + 1
