"""Token ids in coded files: a static range asymmetric numeral system over shared frequency tables.

A store is a folder of binary files, which are groups of blocks one behind the other. A group starts with the frequency table that its blocks share; a
block holds up to ``BLOCK`` ids of neighbouring documents and needs nothing but that table to be decoded:

* the ids are dealt to ``LANES`` lanes in turn; every lane is a coder state of 64 bits, and all lanes of a block share one stream of 32-bit words;
* a checkpoint every ``CHECKPOINT`` rounds keeps the lanes' states and the place in the stream, so decoders can start at any of them;
* a directory names the documents in the block, and checksums cover the stored bytes and the ids that must come out.

All numbers are little-endian. A group begins with ``magic, total bytes, scale bits, different ids, bytes of the table, checksum of the table`` as unsigned 32-bit
integers and the table: its ids, then their frequencies, compressed. A block begins with ``magic, total bytes, range, serial, ids, documents, words, checkpoints,
checksum of what follows, checksum of the ids`` and the first id's place within the range (64 bits); the directory, the checkpoints and the stream follow. A range is a
stretch of the documents' order, so a reader finds every document's place by sums over ranges.

Encoding and decoding advance all lanes of all blocks (or stretches between checkpoints) at hand together.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedge.llm.scratch import materialized
from sedge.llm.slicing import by_bytes
from sedge.llm.word_ids import column_tokens
from sedge.operators.ordering import order_cuts, with_range

MAGIC = 0x534E4152
LANES, BLOCK, CHECKPOINT = 32, 1 << 16, 256
SCALE_BITS = 20
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
# Blocks that share a table and are encoded together, blocks decoded together, and groups of one file.
GROUP_BLOCKS, DECODED_BLOCKS, FILE_GROUPS = 64, 16, 4
HEAD = struct.Struct("<10Iq")
# A document's entry: its number in the range, ids in all, ids before this block, ids in it, bytes of its key (or NO_KEY).
ENTRY = struct.Struct("<4qI")
NO_KEY = 0xFFFFFFFF
GROUP_MAGIC, GROUP_HEAD = 0x50554F47, struct.Struct("<6I")
# Every group is a line of the text sink; this byte ends it.
LINE_END = b"\n"


def quantised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits in proportion to the counts, at least 1 wherever there is a count."""
    total, scale = int(counts.sum()), 1 << bits
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), np.int64)
    if len(used) > scale:
        raise ValueError("more different ids than the table has places")
    share = counts[used] / total * (scale - len(used))
    out = np.floor(share).astype(np.int64)
    left = scale - len(used) - int(out.sum())
    out[np.lexsort((used, out - share))[:left]] += 1
    freq = np.zeros(len(counts), np.int64)
    freq[used] = out + 1
    return freq


@dataclass(frozen=True)
class Coder:
    """The shared table in the forms that encoding and decoding need."""

    freq: np.ndarray
    before: np.ndarray
    bits: int

    @classmethod
    def of(cls, freq: np.ndarray, bits: int = SCALE_BITS) -> "Coder":
        before = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return cls(freq.astype(np.uint64), before.astype(np.uint64), bits)

    def ids_of(self) -> np.ndarray:
        """The id of each of the 2**bits places."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: states at its checkpoints (checkpoints x lanes), the stream's place at each, and the stream."""
        sizes = np.array([len(b) for b in blocks])
        rounds = -(-int(sizes.max()) // LANES)
        ids = np.zeros((len(blocks), rounds * LANES), np.uint32)
        for k, b in enumerate(blocks):
            ids[k, : len(b)] = b
        ids = ids.reshape(len(blocks), rounds, LANES)
        state = np.full((len(blocks), LANES), LOW, np.uint64)
        bits, room = np.uint64(self.bits), np.uint64(63 - self.bits)
        words = np.zeros((len(blocks), rounds * LANES), np.uint32)
        filled = np.zeros(len(blocks), np.int64)
        points = -(-rounds // CHECKPOINT)
        states, places = np.zeros((points, len(blocks), LANES), np.uint64), np.zeros((points, len(blocks)), np.int64)
        lane = np.arange(LANES)
        whole_rounds = int(sizes.min()) // LANES
        for r in range(rounds - 1, -1, -1):
            now = ids[:, r]
            freq = self.freq[now]
            out = (state >> room) >= freq
            if r >= whole_rounds:
                real = r * LANES + lane[None, :] < sizes[:, None]
                freq, out = np.where(real, freq, np.uint64(1)), out & real
            many = out.sum(1)
            if many.any():
                # The stream is written from its end: the last lane first.
                rank = many[:, None] - np.cumsum(out, 1)
                block, at = np.nonzero(out)
                words[block, filled[block] + rank[block, at]] = state[block, at].astype(np.uint32)
                state = np.where(out, state >> WORD, state)
                filled += many
            whole = state // freq
            coded = (whole << bits) + (state - whole * freq) + self.before[now]
            state = coded if r < whole_rounds else np.where(real, coded, state)
            if r % CHECKPOINT == 0:
                states[r // CHECKPOINT], places[r // CHECKPOINT] = state, filled
        out = []
        for k, n in enumerate(sizes.tolist()):
            own = -(-n // (LANES * CHECKPOINT))
            out.append((states[:own, k], filled[k] - places[:own, k], words[k, : filled[k]][::-1].copy()))
        return out

    def decode(self, stretches: list[tuple[np.ndarray, int, np.ndarray, int]], lookup: np.ndarray) -> list[np.ndarray]:
        """Ids of stretches given as (lanes' states, place in the stream, stream, number of ids)."""
        sizes = np.array([s[3] for s in stretches])
        rounds = -(-int(sizes.max()) // LANES)
        state = np.stack([s[0] for s in stretches])
        streams: dict[int, int] = {}
        parts, total = [], 0
        for _, _, stream, _ in stretches:
            if id(stream) not in streams:
                streams[id(stream)] = total
                parts.append(stream)
                total += len(stream)
        words = np.concatenate([*parts, np.zeros(1, np.uint32)]).astype(np.uint64)
        place = np.array([streams[id(s[2])] + s[1] for s in stretches])
        ids = np.zeros((len(stretches), rounds, LANES), np.uint32)
        mask, bits, lane = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.arange(LANES)
        whole_rounds = int(sizes.min()) // LANES
        for r in range(rounds):
            slot = state & mask
            now = lookup[slot]
            ids[:, r] = now
            read = self.freq[now] * (state >> bits) + slot - self.before[now]
            state = read if r < whole_rounds else np.where(r * LANES + lane[None, :] < sizes[:, None], read, state)
            need = state < LOW
            rank = np.cumsum(need, 1)
            at = np.minimum(place[:, None] + rank - 1, len(words) - 1)
            state = np.where(need, (state << WORD) | words[at], state)
            place = place + rank[:, -1]
        return [ids[k].reshape(-1)[:n] for k, n in enumerate(sizes.tolist())]


Document = tuple[int, int, int, int, bytes | None]


def packed_blocks(coder: Coder, range_: int, first: int, place: int, blocks: list[tuple[np.ndarray, list[Document]]]) -> Iterator[bytes]:
    """The stored bytes of blocks of ids with their directories; ``first`` is the first one's number, ``place`` that of its first id."""
    if not blocks:
        return
    for k, ((ids, documents), (states, places, stream)) in enumerate(zip(blocks, coder.encode([b for b, _ in blocks]), strict=True)):
        entries = b"".join(ENTRY.pack(*d[:4], NO_KEY if d[4] is None else len(d[4])) + (d[4] or b"") for d in documents)
        body = entries + places.astype("<u4").tobytes() + states.astype("<u8").tobytes() + stream.astype("<u4").tobytes()
        head = HEAD.pack(
            MAGIC, HEAD.size + len(body), range_, first + k, len(ids), len(documents), len(stream), len(places), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()), place
        )
        place += len(ids)
        yield head + body


@dataclass
class Block:
    range_: int
    place: int
    n: int
    crc: int
    documents: list[Document]
    stretches: list[tuple[np.ndarray, int, np.ndarray, int]]


def unpacked_blocks(content: memoryview) -> Iterator[Block]:
    """The blocks of a group; damaged ones raise."""
    at = 0
    while at < len(content):
        magic, size, range_, serial, n, documents, words, points, check, crc, place = HEAD.unpack_from(content, at)
        body = content[at + HEAD.size : at + size]
        if magic != MAGIC or zlib.crc32(body) != check:
            raise ValueError(f"block {serial} of range {range_} is damaged")
        found, inner = [], 0
        for _ in range(documents):
            *numbers, key = ENTRY.unpack_from(body, inner)
            inner += ENTRY.size
            name = None if key == NO_KEY else bytes(body[inner : inner + key])
            inner += len(name or b"")
            found.append((*numbers, name))
        places = np.frombuffer(body, "<u4", points, inner).astype(np.int64)
        inner += 4 * points
        states = np.frombuffer(body, "<u8", points * LANES, inner).astype(np.uint64).reshape(points, LANES)
        stream = np.frombuffer(body, "<u4", words, inner + 8 * points * LANES)
        step = CHECKPOINT * LANES
        yield Block(range_, place, n, crc, found, [(states[k], int(places[k]), stream, min(step, n - k * step)) for k in range(points)])
        at += size


def packed_group(range_: int, first: int, place: int, blocks: list[tuple[np.ndarray, list[Document]]]) -> bytes:
    """Blocks with the table of their own frequencies in front."""
    counts = np.zeros(1 + max(int(b.max()) for b, _ in blocks), np.int64)
    for ids, _ in blocks:
        counts[: int(ids.max()) + 1] += np.bincount(ids)
    freq = quantised(counts)
    used = np.flatnonzero(freq)
    table = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + freq[used].astype("<u4").tobytes(), 1)
    body = b"".join(packed_blocks(Coder.of(freq), range_, first, place, blocks))
    head = GROUP_HEAD.pack(GROUP_MAGIC, GROUP_HEAD.size + len(table) + len(body) + len(LINE_END), SCALE_BITS, len(used), len(table), zlib.crc32(table))
    return head + table + body


def unpacked_groups(content: memoryview) -> Iterator[tuple[Coder, Iterator[Block]]]:
    """Coder and blocks of each group of a file."""
    at = 0
    while at < len(content):
        magic, size, bits, many, packed, check = GROUP_HEAD.unpack_from(content, at)
        table = content[at + GROUP_HEAD.size : at + GROUP_HEAD.size + packed]
        if magic != GROUP_MAGIC or zlib.crc32(table) != check:
            raise ValueError(f"the table at byte {at} is damaged")
        steps, used = np.split(np.frombuffer(zlib.decompress(table), "<u4").astype(np.int64), [many])
        freq = np.zeros(int(steps.sum()) + 1, np.int64)
        freq[np.cumsum(steps)] = used
        yield Coder.of(freq, bits), unpacked_blocks(content[at + GROUP_HEAD.size + packed : at + size - len(LINE_END)])
        at += size


def _times_x(value: int, bytes_: int) -> int:
    """A checksum's polynomial times x**(8 * bytes_): what its text adds to the checksum of a text with so many bytes behind it."""

    def product(a: int, b: int) -> int:
        out = 0
        while a:
            if a & 0x80000000:
                out ^= b
            a = (a << 1) & 0xFFFFFFFF
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    power = 0x00800000  # x**8
    while bytes_:
        if bytes_ & 1:
            value = product(value, power)
        power = product(power, power)
        bytes_ >>= 1
    return value


def _encoder(kind: str, group_blocks: int):
    """Groups of one range of documents, which arrive in order."""

    def encode(batches):
        blocks: list[tuple[np.ndarray, list[Document]]] = []
        parts, documents, held = [], [], 0
        serial = place = number = range_ = 0

        def out():
            nonlocal blocks, serial, place
            line = packed_group(range_, serial, place, blocks)
            serial, place, blocks = serial + len(blocks), place + sum(len(b) for b, _ in blocks), []
            return pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], names=["block"])

        for batch in by_bytes(batches, 2):
            for own_range, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                range_ = own_range  # one for all rows of a task
                ids, done = np.frombuffer(ids.as_buffer(), kind), 0
                name = None if key is None else key.encode()
                while done < len(ids):
                    take = min(BLOCK - held, len(ids) - done)
                    parts.append(ids[done : done + take])
                    documents.append((number, len(ids), done, take, name))
                    held, done = held + take, done + take
                    if held == BLOCK:
                        blocks.append((np.concatenate(parts), documents))
                        parts, documents, held = [], [], 0
                        if len(blocks) >= group_blocks:
                            yield out()
                number += 1
            parts = [p.copy() for p in parts]
        if held:
            blocks.append((np.concatenate(parts), documents))
        if blocks:
            yield out()

    return encode


def id_bytes(vocabulary: str, end_id: int) -> int:
    """Bytes that hold every id of a vocabulary."""
    return 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _with_ids(rows: DataFrame, vocabulary: str, end_id: int, kind: str) -> DataFrame:
    """``range, key, row`` as they are and ``ids`` in place of the text, the end id included."""
    names = ["range", "key", "row", "ids"]

    def encode(batches):
        tokens = column_tokens(vocabulary)
        for batch in by_bytes(batches, 3):
            ids, begins = tokens.encode(batch.column(3))
            data = np.insert(ids, begins[1:], end_id).astype(kind)
            at = ((begins + np.arange(len(begins))) * data.itemsize).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), packed], names=names)

    key = rows.schema["key"].dataType.simpleString()
    return rows.select("range", "key", "row", "text").mapInArrow(encode, f"range int, key {key}, row long, ids binary")


def write_tokens(df: DataFrame, key: str, text: str, vocabulary: str, path: str, end_id: int, group_blocks: int = GROUP_BLOCKS) -> None:
    """Every row's ids, with ``end_id`` behind each text, in ascending order of the key as a store below ``path``.

    Null and empty texts are the end id alone. Null keys come first; rows of one key are in the order of reading, and many of them are
    still spread over ranges. An empty table gives a store without blocks. Other columns are not read. Keys are numbers or strings.
    Texts are encoded once: the ranges' ends come from a sample of the keys, and ids go straight to their range.
    """
    spark, kind = df.sparkSession, f"<u{id_bytes(vocabulary, end_id)}"
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = order_cuts(rows.select("key", "row"), ["key", "row"], ranges)
    placed = _with_ids(with_range(rows, ["key", "row"], cuts, "range"), vocabulary, end_id, kind)
    ordered = placed.repartitionById(len(cuts) + 1, "range").sortWithinPartitions(F.asc_nulls_first("key"), "row")
    groups = ordered.select("range", F.col("key").cast("string"), "ids").mapInArrow(_encoder(kind, group_blocks), "block binary")
    # The text sink writes a string's bytes as they are.
    lines = groups.select(F.col("block").cast("string").alias("value"))
    writer = lines.write.option("encoding", "ISO-8859-1").option("lineSep", LINE_END.decode()).option("maxRecordsPerFile", FILE_GROUPS)
    writer.text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``key`` (as a string), ``start, n_tokens, ids_crc32`` of every document of a store, decoded from its files; with ``ids`` on demand.

    ``start`` counts the ids of all documents before it. Checksums of the stored bytes and of the decoded ids are compared on the way,
    and damage raises an error. Documents that several blocks or files hold are put together from the checksums of
    their pieces, or with ``ids`` from the pieces. A file is one task of at most FILE_GROUPS groups.
    """
    names = ["range", "number", "key", "first", "n_all", "done", "n", "crc", "ids"]

    def rows_of(blocks: list[Block], coder: Coder, lookup: np.ndarray):
        decoded = coder.decode([s for b in blocks for s in b.stretches], lookup)
        rows, at = [], 0
        for b in blocks:
            ids = np.concatenate(decoded[at : at + len(b.stretches)]).astype("<u4")
            at += len(b.stretches)
            if zlib.crc32(ids.tobytes()) != b.crc:
                raise ValueError(f"ids from place {b.place} of range {b.range_} do not match their checksum")
            inner = 0
            for number, n_all, done, n, name in b.documents:
                own = ids[inner : inner + n].tobytes()
                # The document's first id, whichever piece this is.
                first = b.place + inner - done
                crc = _times_x(zlib.crc32(own), 4 * (n_all - done - n)) if n < n_all else zlib.crc32(own)
                rows.append((b.range_, number, None if name is None else name.decode(), first, n_all, done, n, crc, own if with_ids else None))
                inner += n
        kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                for coder, blocks in unpacked_groups(memoryview(content.as_buffer())):
                    lookup, held = coder.ids_of(), []
                    for block in blocks:
                        held.append(block)
                        if len(held) == DECODED_BLOCKS:
                            yield rows_of(held, coder, lookup)
                            held = []
                    if held:
                        yield rows_of(held, coder, lookup)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    ddl = "range int, number long, key string, first long, n_all long, done long, n long, crc long, ids binary"
    pieces = materialized(files.mapInArrow(decode, ddl), "decoded")
    one = pieces.filter("n = n_all").drop("done", "n")
    joined = F.array_sort(F.collect_list(F.struct("done", "ids")))
    several = pieces.filter("n < n_all").groupBy("range", "number", "key", "first", "n_all").agg(
        F.bit_xor("crc").alias("crc"), F.sum("n").alias("n"),
        (F.aggregate(joined, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])) if with_ids else F.lit(None).cast("binary")).alias("ids"),
    )
    whole = one.unionByName(several.filter(F.expr("n = n_all or raise_error('a piece of a document is missing') is null")).drop("n"))
    # One number per range, so at most as many rows as the store was written with partitions.
    sums = pieces.groupBy("range").agg(F.sum("n").alias("sum"))
    before = sums.select("range", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    columns = ["key", (F.col("before") + F.col("first")).alias("start"), F.col("n_all").alias("n_tokens"), F.col("crc").alias("ids_crc32")]
    return whole.join(F.broadcast(before), "range").select(*columns, *(["ids"] if with_ids else []))
