"""Coded token files: exact round trips, checkpoints, checksums, and the query against the tokenizer."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sedge.llm import token_store as T
from sedge.llm.queries import registry
from sedge.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def zipf_ids(n, seed=1, vocabulary=3000):
    return np.minimum(np.random.default_rng(seed).zipf(1.3, n), vocabulary - 1).astype(np.uint32)


def test_frequencies():
    counts = np.array([0, 1, 10**12, 3, 0, 7])
    freq = T.quantised(counts, 8)
    assert freq.sum() == 256 and ((freq > 0) == (counts > 0)).all() and freq.argmax() == 2
    assert T.quantised(np.zeros(4, np.int64)).tolist() == [0] * 4
    with pytest.raises(ValueError, match="places"):
        T.quantised(np.ones(300, np.int64), 8)


@pytest.mark.parametrize("sizes", [[1], [31, 32, 33], [5, 8191, 8192, 8193, 65536, 40000]])
def test_blocks_come_back_from_any_checkpoint(sizes):
    ids = zipf_ids(sum(sizes))
    coder = T.Coder.of(T.quantised(np.bincount(ids)))
    blocks = np.split(ids, np.cumsum(sizes)[:-1])
    directory = lambda b, k: [(k, len(b), 0, len(b), None if k % 2 else f"key {k}".encode())]
    stored = list(T.packed_blocks(coder, 3, 10, 77, [(b, directory(b, k)) for k, b in enumerate(blocks)]))
    content = b"".join(stored)
    read = list(T.unpacked_blocks(memoryview(content)))
    lookup, place = coder.ids_of(), 77
    for k, (block, want) in enumerate(zip(read, blocks, strict=True)):
        assert (block.range_, block.place, block.documents) == (3, place, directory(want, k)) and block.crc == zlib.crc32(want.tobytes())
        assert len(block.stretches) == -(-len(want) // (T.LANES * T.CHECKPOINT))
        for at in (0, len(block.stretches) - 1):  # one stretch alone
            (got,) = coder.decode([block.stretches[at]], lookup)
            begin = at * T.LANES * T.CHECKPOINT
            assert (got == want[begin : begin + len(got)]).all()
        assert (np.concatenate(coder.decode(block.stretches, lookup)) == want).all()
        place += len(want)
    if max(sizes) > 10_000:
        assert len(content) < 1.5 * len(ids)
    damaged = bytearray(content)
    damaged[T.HEAD.size + 60] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        list(T.unpacked_blocks(memoryview(bytes(damaged))))


def test_groups_bring_their_tables():
    ids = [zipf_ids(70_000, seed, 60_000 if seed else 9) for seed in (0, 1)]
    content = b""
    for k, own in enumerate(ids):
        blocks = [(own[:65536], [(0, len(own), 0, 65536, b"a")]), (own[65536:], [(0, len(own), 65536, len(own) - 65536, b"a")])]
        content += T.packed_group(k, 0, 0, blocks) + T.LINE_END
    for (coder, blocks), own in zip(T.unpacked_groups(memoryview(content)), ids, strict=True):
        assert (np.concatenate([x for b in blocks for x in coder.decode(b.stretches, coder.ids_of())]) == own).all()
    damaged = bytearray(content)
    damaged[T.GROUP_HEAD.size + 3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(T.unpacked_groups(memoryview(bytes(damaged))))


def test_checksums_of_pieces():
    text = bytes(range(200)) * 3
    for cut in (0, 1, 17, 599):
        assert T._times_x(zlib.crc32(text[:cut]), len(text) - cut) ^ zlib.crc32(text[cut:]) == zlib.crc32(text)


def answer(rows, tokenizer):
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    out, start = [], 0
    for (k, _), own in sorted(zip(rows, ids, strict=True), key=lambda x: (x[0][0] is not None, x[0][0])):
        out.append((k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def test_query_against_the_tokenizer(spark, tokenizer):
    found = registry.queries["op12_rans_tokens"](spark, SF)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, found.collect())) == answer(docs, tokenizer)


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, tokenizer, tmp_path, monkeypatch, small):
    if small:  # documents span blocks, groups and files
        monkeypatch.setattr(T, "FILE_GROUPS", 1)
    rows = [(5, None), (3, ""), (None, "no key"), (-7, "minus <|endoftext|> \x1c É é"), (9, "word and more " * 70_000), (12, "tail"), (10, " \n ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    path = str(tmp_path / "store")
    T.write_tokens(df, "doc_id", "text", vocabulary_path(), path, 2, **({"group_blocks": 1} if small else {}))
    read = T.read_tokens(spark, path, with_ids=True).selectExpr("cast(key AS long)", "start", "n_tokens", "ids_crc32", "ids").collect()
    got = sorted((tuple(r)[:4] for r in read), key=lambda r: r[1])
    assert got == answer(rows, tokenizer)
    for r in read:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
    if small:
        assert len(list((tmp_path / "store").glob("part-*"))) > 4
    empty = str(tmp_path / "empty")
    T.write_tokens(df.filter("false"), "doc_id", "text", vocabulary_path(), empty, 2)
    assert T.read_tokens(spark, empty).count() == 0


def test_many_rows_of_one_key(spark, tokenizer, tmp_path):
    rows = [(1 if k % 3 else k, f"text number {k % 5}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    T.write_tokens(df, "doc_id", "text", vocabulary_path(), str(tmp_path / "s"), 2)
    found = sorted(((int(r["key"]), r["start"], r["n_tokens"]) for r in T.read_tokens(spark, str(tmp_path / "s")).collect()), key=lambda r: r[1])
    assert [k for k, _, _ in found] == sorted(k for k, _ in rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:], strict=False))
    parts = {int(r["key"]) for r in T.read_tokens(spark, str(tmp_path / "s")).collect()}
    assert parts == {k for k, _ in rows}
