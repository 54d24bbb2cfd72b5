"""Token counts from flat token files: a scan for end-of-document ids.

A token file is nothing but ids of two bytes, little-endian, with one end id behind each
document. It has no index, so a document's length is only known from the places of
the end ids before and behind it. Files are looked through in blocks; one comparison over a block
finds its end ids; and a prefix scan over the blocks (the last end id so far, the
number of them so far) stitches documents that span blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.llm.scratch import materialized
from sedge.llm.tokens import END_OF_TEXT, word_tokens

WIDTH = 2
BLOCK_BYTES = 1 << 20
SCAN_BLOCKS = 1024
FILE_ROWS = 20_000
# A key as five ids of 13 bits each, so none of them is an end id; the 65th bit marks a null key.
KEY_IDS, KEY_BITS = 5, 13


def key_ids(key: int | None) -> list[int]:
    value = 1 << 64 if key is None else key & ((1 << 64) - 1)
    return [value >> (KEY_BITS * k) & ((1 << KEY_BITS) - 1) for k in range(KEY_IDS)]


def key_of(ids: Column) -> Column:
    """The key of ``key_ids`` from an array column."""
    bits = [F.shiftleft(ids[k].cast("long"), KEY_BITS * k) for k in range(KEY_IDS)]
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    return F.when(F.shiftright(ids[KEY_IDS - 1], 64 - KEY_BITS * (KEY_IDS - 1)) == 0, value)


def write_token_files(df: DataFrame, key: str, text: str, vocabulary: str, path: str, end_id: int = END_OF_TEXT) -> None:
    """Each text's ids, then its key as ``KEY_IDS`` ids, then the end id, as flat files below ``path``.

    Spark's text sink writes the ids' bytes as they are, with the end id for a line's end, so any file system
    that Spark knows will do. Null and empty texts have no ids but are written.
    """

    def encode(batches):
        tokens = word_tokens(vocabulary, False)
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(tokens.encode(body), "<u4").astype("<u2")
                out.append(ids.tobytes() + np.array(key_ids(doc), "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    rows = df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(encode, "ids binary")
    end = int(end_id).to_bytes(WIDTH, "little").decode("latin-1")
    writer = rows.select(F.col("ids").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end)
    writer.option("maxRecordsPerFile", FILE_ROWS).text(path)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of the token files below ``path``, each of up to 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter("length > 0").select(F.col("path").alias("file"), "content")


def scan_blocks(files: DataFrame, end_id: int = END_OF_TEXT, halo: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What each block of the files shows by itself.

    A row per end id: ``at`` (its place in the file), ``nth`` in the block, ``before`` (the place of the one before
    in the block, or null) and ``trailer`` (the ``halo`` ids in front of it). And a row per block with ``ends`` and ``last``,
    its number of end ids and the last one's place, and ``upto``, where it stops. Blocks are views into
    the file's bytes, so a task holds one batch of files and nothing twice.
    """
    ddl = "file string, block int, at long, nth int, before long, trailer array<int>, ends long, last long, upto long"
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
    step = block_bytes // WIDTH

    def rows(file: str, block: int, ids: np.ndarray):
        base, upto = block * step, min((block + 1) * step, len(ids))
        place = np.flatnonzero(ids[base:upto] == end_id) + base
        n = len(place)
        around = place[:, None] + np.arange(-halo, 0)
        trailer = np.where(around >= 0, ids[np.maximum(around, 0)], 0).astype(np.int32)
        sizes = np.arange(n + 1, dtype=np.int32) * halo
        none = pa.nulls(n, pa.int64())
        fields = [
            pa.repeat(file, n), pa.repeat(pa.scalar(block, pa.int32()), n), pa.array(place, pa.int64()), pa.array(np.arange(n), pa.int32()),
            pa.array(np.r_[-1, place[:-1]][:n], pa.int64(), mask=np.arange(n) == 0),
            pa.ListArray.from_arrays(pa.array(sizes), pa.array(trailer.reshape(-1))), none, none, none,
        ]
        yield pa.RecordBatch.from_arrays(fields, names=names)
        summary = [file, block, None, None, None, None, n, int(place[-1]) if n else -1, upto]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(summary, kinds, strict=True)], names=names)

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2", count=len(content.as_buffer()) // WIDTH)
                for block in range(-(-len(ids) // step)):
                    yield from rows(file.as_py(), block, ids)

    return files.mapInArrow(scan, ddl)


def stitched(scanned: DataFrame) -> DataFrame:
    """``file, ordinal, start, n_tokens, trailer, ended``: one row per document.

    The prefix scan has two levels, so a file of any number of blocks is no single task: sums of ``SCAN_BLOCKS``
    blocks first, then blocks within their group. Ids behind a file's last end id are a document with ``ended`` false.
    """
    sums = scanned.filter("at is null").withColumn("group", F.expr(f"block div {SCAN_BLOCKS}"))
    groups = sums.groupBy("file", "group").agg(F.sum("ends").alias("g_ends"), F.max("last").alias("g_last"))
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select(
        "file", "group", F.coalesce(F.sum("g_ends").over(over), F.lit(0)).alias("g_base"), F.coalesce(F.max("g_last").over(over), F.lit(-1)).alias("g_open")
    )
    within = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = sums.select(
        "file", "group", "block", "upto", "last", "ends",
        F.coalesce(F.sum("ends").over(within), F.lit(0)).alias("l_base"), F.coalesce(F.max("last").over(within), F.lit(-1)).alias("l_open"),
    )
    scan = local.join(carried, ["file", "group"]).select(
        "file", "block", "upto", (F.col("g_base") + F.col("l_base")).alias("base"), F.greatest("g_open", "l_open").alias("open"),
        F.greatest("g_open", "l_open", "last").alias("seen"), (F.col("g_base") + F.col("l_base") + F.col("ends")).alias("through"),
    )
    ends = scanned.filter("at is not null").select("file", "block", "at", "nth", "before", "trailer")
    start = F.coalesce("before", "open") + 1
    whole = ends.join(scan.select("file", "block", "base", "open"), ["file", "block"]).select(
        "file", (F.col("base") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), "trailer", F.lit(True).alias("ended")
    )
    tail = scan.groupBy("file").agg(F.max("upto").alias("upto"), F.max("seen").alias("seen"), F.max("through").alias("through"))
    rest = tail.filter("upto > seen + 1").select(
        "file", F.col("through").alias("ordinal"), (F.col("seen") + 1).alias("start"), (F.col("upto") - F.col("seen") - 1).alias("n_tokens"),
        F.lit(None).cast("array<int>").alias("trailer"), F.lit(False).alias("ended"),
    )
    return whole.unionByName(rest)


def count_tokens(spark: SparkSession, path: str, end_id: int = END_OF_TEXT, halo: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents of the token files below ``path``; see ``stitched``.

    Two end ids in a row are an empty document. Empty files and folders give no rows. Documents may span any number of blocks.
    """
    if block_bytes % WIDTH:
        raise ValueError("blocks hold whole ids")
    return stitched(materialized(scan_blocks(token_files(spark, path), end_id, halo, block_bytes), "scanned"))


def document_tokens(df: DataFrame, key: str, text: str, vocabulary: str, path: str) -> DataFrame:
    """``key, n_tokens`` of every row, by writing flat files to ``path`` and scanning them.

    Null and empty texts have 0 tokens; repeated rows and null keys are kept; an empty table gives no rows; other
    columns are not read. Strings of special tokens in a text are ordinary text.
    """
    write_token_files(df, key, text, vocabulary, path)
    found = count_tokens(df.sparkSession, path, halo=KEY_IDS)
    return found.select(key_of(F.col("trailer")).alias(key), (F.col("n_tokens") - KEY_IDS).alias("n_tokens"))
