"""Jump hashing against the published loop; exact duplicates against plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from sedge.llm import digest_merge as D
from sedge.llm import jump as J

DOCS = "/root/testdata/sf0.001/documents.parquet"


def one_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_same_as_one_key_at_a_time():
    keys = np.r_[0, 1, np.random.default_rng(1).integers(0, 1 << 63, 500)].astype(np.uint64)
    for shards in (1, 2, 24, 25, 1000):
        assert J.jump(keys, shards).tolist() == [one_jump(int(k), shards) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64)
    old, new = J.jump(keys, 24), J.jump(keys, 25)
    assert set(new[old != new]) == {24} and abs((old != new).mean() - 1 / 25) < 0.006
    assert Counter(old.tolist()).most_common()[-1][1] > 700


def test_shards_need_a_number():
    with pytest.raises(ValueError, match="at least one"):
        J.jump(np.zeros(1, np.uint64), 0)


def test_slots_have_no_gaps(spark):
    rows = [(k, f"text {k}", k) for k in range(300)] + [(7, "text 7", 0)] * 50 + [(7, "é other", 0), (None, None, 1), (None, "", 1), (-5, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = J.shard_rows(df, "doc_id", "text", 4, buckets=3).collect()
    assert len(got) == len(rows)
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({k for k, _, _ in rows})
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    assert J.shard_rows(df.filter("false"), "doc_id", "text", 4).count() == 0


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


ROWS = [(1, "Same", 0), (2, "sAME", 0), (3, "same", 0), (4, "É", 0), (5, "é", 0), (6, None, 0), (7, "", 0), (8, "z" * 200_000, 0), (8, "z" * 200_000, 0), (None, "Same", 0), (None, "lone", 0)]


@pytest.mark.parametrize(("keep", "fan_in"), [("max", 2), ("max", 16), ("min", 3)])
def test_groups(spark, keep, fan_in):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, run int").repartition(7)
    got = sorted(map(tuple, D.exact_duplicates(df, "doc_id", "text", fan_in, keep).collect()), key=repr)
    want = []
    for key, text, _ in ROWS:
        group = [k for k, t, _ in ROWS if fold(t) == fold(text)]
        known = [k for k in group if k is not None]
        best = (max if keep == "max" else min)(known) if known else None
        want.append((key, best, len(group), key == best, hashlib.sha256(fold(text).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert D.exact_duplicates(df.filter("false"), "doc_id", "text").count() == 0


def test_rows_that_stay(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, run int").repartition(3)
    got = D.first_of_equals(df, "doc_id", "text")
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], len(r["text"] or "")) for r in got.collect()), key=repr) == sorted([(3, 4), (4, 1), (5, 1), (7, 0), (8, 200_000), (None, 4)], key=repr)


def test_rounds_end_in_one_run(spark):
    docs = spark.read.parquet(DOCS).repartition(40)
    runs = D.digest_runs(docs, "doc_id", "text")
    merged = D.merge_runs(runs, 3)
    assert merged.count() == runs.select("digest").distinct().count()
    assert merged.agg({"n": "sum"}).first()[0] == docs.count()
