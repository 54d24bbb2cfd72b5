"""Importance resampling of documents towards a target collection by hashed n-gram counts.

Features of a text are its runs of one to three words, hashed into buckets by checksum. How much more often the target has
a bucket than all documents is the bucket's gain; a document's gains add up to its weight; and a Gumbel number drawn from its
key makes the highest scores a sample without replacement in proportion to the weights.

Inside a task, a part of a batch puts all its n-grams into one open-addressed table (``interning``): a slot holds one n-gram's bucket
and count, so the checksum is taken once per different n-gram; occurrences keep their slot's number and gather the gains through it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.hashing import text_buffers
from sedge.llm.interning import LONG, Spans, intern
from sedge.llm.scratch import materialized
from sedge.llm.slicing import by_bytes
from sedge.operators.ordering import positions

LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
# Words whose n-grams enter one table.
PART_WORDS = 1 << 16
# ASCII but letters and digits separates; A-Z count as a-z.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256)], np.uint8)


def _checksum_table() -> np.ndarray:
    """CRC-32 steps for two bytes at once."""
    value = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


TWO_BYTES = _checksum_table()
ONE_BYTE = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def checksums(spans: Spans, picked: np.ndarray) -> np.ndarray:
    """CRC-32 of the picked spans."""
    order = picked[np.argsort(spans.size[picked], kind="stable")]
    size, at = spans.size[order], spans.at[order]
    out = np.full(len(order), 0xFFFFFFFF, np.uint32)
    from_long, begin = int(np.searchsorted(size, LONG)), 0
    while begin < from_long:
        n = int(size[begin])
        end = int(np.searchsorted(size, n, "right"))
        crc, where, word = out[begin:end], at[begin:end], None
        for k in range(n // 2):
            word = spans.words[where + 2 * k] if k % 4 == 0 else word >> np.uint64(16)
            crc[:] = TWO_BYTES[(crc ^ word.astype(np.uint32)) & np.uint32(0xFFFF)] ^ (crc >> np.uint32(16))
        if n % 2:
            crc[:] = ONE_BYTE[(crc ^ spans.data[where + n - 1]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        begin = end
    out[:from_long] ^= np.uint32(0xFFFFFFFF)
    view = memoryview(spans.data)
    for k in range(from_long, len(order)):
        out[k] = zlib.crc32(view[int(at[k]) : int(at[k] + size[k])])
    back = np.empty(int(picked.max(initial=-1)) + 1, np.uint32)
    back[order] = out
    return back[picked]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, its words' first and last (exclusive) bytes, and the row of each word."""
    data, at = text_buffers(column)
    data, at = data[at[0] : at[-1]], at - at[0]
    word = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(at, starts, "right") - 1


def gram_slots(column: pa.Array, buckets: int, part_words: int = PART_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of a text column: bucket and count of every slot; row and slot of every occurrence."""
    data, starts, ends, row = _words(column)
    for begin in range(0, len(starts), part_words):
        # The next words complete the n-grams that begin at the last ones.
        end = min(begin + part_words, len(starts))
        upto = min(end + LONGEST - 1, len(starts))
        size = ends[begin:upto] - starts[begin:upto]
        place = np.cumsum(size + 1) - (size + 1)
        shift = np.repeat(place - (np.cumsum(size) - size), size)
        source = np.arange(int(size.sum())) + np.repeat(starts[begin:upto] - (np.cumsum(size) - size), size)
        joined = np.full(int(size.sum()) + len(size), ord(" "), np.uint8)
        joined[np.arange(len(source)) + shift] = LOWER[data[source]]
        own, at, sizes, rows = row[begin:upto], [], [], []
        for n in range(1, LONGEST + 1):
            first = np.arange(min(end - begin, len(size) - n + 1))
            first = first[own[first] == own[first + n - 1]]
            at.append(place[first])
            sizes.append(place[first + n - 1] + size[first + n - 1] - place[first])
            rows.append(own[first])
        spans = Spans(joined, np.concatenate(at), np.concatenate(sizes))
        slots, held, counts = intern(spans)
        yield checksums(spans, held) % np.uint32(buckets), counts, np.concatenate(rows), slots


def bucket_counts(df: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features per bucket over all texts; at most ``buckets`` rows reach the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in by_bytes(batches, 0):
            for bucket, counts, _, _ in gram_slots(batch.column(0), buckets):
                total += np.bincount(bucket, counts, buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    parts = df.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target rate over source rate per bucket, each count smoothed by one."""
    n, whole, aim = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * (whole + n) / ((float(s) + 1) * (aim + n)))) for s, t in zip(source, target, strict=True)], np.int64
    )


def weigh(df: DataFrame, key: str, text: str, gain: np.ndarray) -> DataFrame:
    """``key, n_words, n_features, weight`` per row."""
    buckets = len(gain)

    def add(batches):
        for batch in by_bytes(batches, 1):
            rows = len(batch)
            features, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            _, _, _, row = _words(batch.column(1))
            for bucket, _, owner, slots in gram_slots(batch.column(1), buckets):
                features += np.bincount(owner, minlength=rows)
                # Sums of whole numbers below 2**53 are exact in doubles.
                weight += np.bincount(owner, gain[bucket][slots], rows).astype(np.int64)
            fields = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in (np.bincount(row, minlength=rows), features, weight))]
            yield pa.RecordBatch.from_arrays(fields, names=[key, "n_words", "n_features", "weight"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(add, f"`{key}` {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number that key and seed decide; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    df: DataFrame, key: str, text: str, target: DataFrame, target_text: str,
    percent: int = 5, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = 42,
) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank``: one row per row; ``rank`` counts the drawn ones from 1, the others have none.

    Drawn are the highest scores, ``percent`` in a hundred of the rows with at least ``least_words`` words, rounded down; ties go to the
    smaller key (a null key is the smallest), and equal keys in the order read. Null, empty and wordless texts have no features
    and weight 0; rows that repeat are kept and drawn one by one; without documents there are no rows, without a target all features weigh what
    smoothing leaves. Other columns are not read. Keys are numbers or strings.
    """
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, target_text, buckets))
    scored = weigh(df, key, text, gain).withColumn("score", F.col("weight") + gumbel(F.col(key), seed))
    scored = materialized(scored.withColumns({"_row": F.monotonically_increasing_id(), "_falling": -F.col("score")}), "weighed")
    enough = F.col("n_words") >= least_words
    candidates = scored.filter(enough)
    n = candidates.count()
    ranked = positions(candidates, ["_falling", key, "_row"], "rank", rows=n)
    rank = F.when(F.col("rank") < percent * n // 100, F.col("rank").cast("long") + 1)
    others = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(others).select(key, "n_words", "n_features", "weight", "score", "rank")
