"""Cached word ids against the whole tokenizer, and counts from flat files against both."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedge.llm import separators as S
from sedge.llm.tokens import END_OF_TEXT, WordTokens, vocabulary_path

TRICKY = [
    "", " ", "It's we're I'LL don't 's", "A1b22 3.14 #$%! a_b __", "É é École naïve Straße ŒUVRE ÿ", "ΣΑΣ Σ", "İstanbul ǅ ﬁn",
    "éa café", "日本語 한국어 😀👍🏽", "a b c\u0085d", "x\x1cy\x1fz", "<|endoftext|> a <|x|>", "tab\tnew\nline\r\n\x0b\x0c", "«q» “r” ¿s? ½ ²",
    "word" * 300, "́start", "a‍b", "ª º µ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize("specials", [True, False])
def test_same_ids_as_the_tokenizer(tokenizer, specials):
    own = WordTokens(vocabulary_path(), specials)
    tokenizer.encode_special_tokens = not specials
    for text in TRICKY:
        assert ids(own.encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, text
    tokenizer.encode_special_tokens = False


def test_same_ids_on_documents(spark, tokenizer):
    own = WordTokens(vocabulary_path())
    for (text,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert ids(own.encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_full_caches_change_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr("sedge.llm.tokens.CACHE_WORDS", 2)
    own = WordTokens(vocabulary_path())
    text = "the cat and the dog and the cat's end, the end"
    assert ids(own.encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def flat_files(spark, files):
    return spark.createDataFrame([(name, bytearray(np.array(v, "<u2").tobytes())) for name, v in files.items()], "file string, content binary")


def plain(values, end):
    out, start = [], 0
    for k, v in enumerate(values):
        if v == end:
            out.append((len(out), start, k - start, True))
            start = k + 1
    if start < len(values):
        out.append((len(out), start, len(values) - start, False))
    return out


@pytest.mark.parametrize("size", [2, 6, 64, 4096])
def test_documents_span_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(S, "SCAN_BLOCKS", 3)
    rng = np.random.default_rng(size)
    files = {f"f{k}": np.where(rng.random(60) < p, 9, rng.integers(10, 99, 60)).tolist() for k, p in enumerate((0.0, 0.05, 0.3, 1.0))}
    halo = 2
    found = S.stitched(S.scan_blocks(flat_files(spark, files), 9, halo, size)).collect()
    for name, values in files.items():
        got = sorted((r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in found if r["file"] == name)
        assert got == plain(values, 9)
    for r in found:
        if r["trailer"] is not None and r["n_tokens"] >= halo:
            end = r["start"] + r["n_tokens"]
            assert r["trailer"] == files[r["file"]][end - halo : end]


def test_counts_of_a_table(spark, tmp_path, tokenizer):
    rows = [(k, t, k) for k, t in enumerate(TRICKY)] + [(3, "again", 0), (3, "again", 0), (None, "no key", 1), (-7, None, 2), (1 << 62, "long " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(tuple, S.document_tokens(df, "doc_id", "text", vocabulary_path(), str(tmp_path / "a")).collect()), key=repr)
    tokenizer.encode_special_tokens = True
    want = sorted(((k, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows), key=repr)
    tokenizer.encode_special_tokens = False
    assert got == want
    empty = S.document_tokens(df.filter("false"), "doc_id", "text", vocabulary_path(), str(tmp_path / "b"))
    assert empty.columns == ["doc_id", "n_tokens"] and empty.count() == 0


def test_files_are_flat(spark, tmp_path, tokenizer):
    df = spark.createDataFrame([(1, "a cat"), (2, "")], "doc_id long, text string").coalesce(1)
    S.write_token_files(df, "doc_id", "text", vocabulary_path(), str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("part-*")
    values = np.frombuffer(file.read_bytes(), "<u2").tolist()
    cat = tokenizer.encode("a cat", add_special_tokens=False).ids
    assert values == [*cat, *S.key_ids(1), END_OF_TEXT, *S.key_ids(2), END_OF_TEXT]


def test_small_blocks_give_the_same_counts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    S.write_token_files(docs, "doc_id", "text", vocabulary_path(), str(tmp_path / "t"))
    whole, cut = (
        sorted(map(tuple, S.count_tokens(spark, str(tmp_path / "t"), halo=S.KEY_IDS, block_bytes=n).select(S.key_of(F.col("trailer")), "ordinal", "start", "n_tokens").collect()))
        for n in (1 << 20, 256)
    )
    assert whole == cut and len(whole) == docs.count()
    with pytest.raises(ValueError, match="whole ids"):
        S.count_tokens(spark, str(tmp_path / "t"), block_bytes=3)


def test_columns_as_single_texts(tokenizer):
    from sedge.llm.word_ids import ColumnTokens

    texts = [None, "", *TRICKY, "a <|endoftext|> b", "x\x1cy z", "é ü q", "<|", "d'ÉTÉ, l'a.b", "w" * 100 + " end", "many " * 50, "日本 語.", "á b"]
    one = WordTokens(vocabulary_path())
    for known in (3, 10_000):  # a dictionary that overflows all the time, and one that never does
        columns = ColumnTokens(vocabulary_path(), known=known)
        for _ in range(3):
            ids, begins = columns.encode(pa.array(texts))
            for k, text in enumerate(texts):
                assert ids[begins[k] : begins[k + 1]].tobytes() == one.encode(text)
                assert ids[begins[k] : begins[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    assert [len(x) for x in columns.encode(pa.array([], pa.string()))] == [0, 1]
