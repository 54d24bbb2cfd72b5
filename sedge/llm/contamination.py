"""Copies of test items in training texts, exact, edited or paraphrased.

Two neighbouring words of an item are a seed, also with one word more between them in the text. An alignment that reaches the
bound holds at least a number of seeds that grows with the item (``needed_seeds``). So an item can do without its most
frequent ones: half of that number is left out, and the texts that still hold the other half close together are aligned with the item, word for
word (Smith-Waterman). Everything between is joins:

1. a pass over the texts counts the items' seeds; each item keeps its rarer ones (*seed table*);
2. a second pass finds the places of kept seeds, which are joined to the seed table and counted per text, item and window of words;
3. the texts with full windows give their words, which are cut to the window, joined to the item's words and aligned.

A bit table of fixed size stands for the seeds (or texts) inside a pass; what it lets through by chance finds no partner in the join.
Texts are known by their digest, so copies of a text are one, and rows meet the findings at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.hashing import LETTERS, runs_of, word_hashes
from sedge.llm.scratch import materialized
from sedge.llm.slicing import by_bytes

SEED_WORDS = 2
# Items of fewer words are their own seed.
LEAST_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, 1
AT_LEAST = 0.5
# Cells of one batch of alignments.
CELLS = 2_000_000
# Words whose seeds are looked up at once.
PART_WORDS = 1 << 18
# A bit table has 2**BIT_TABLE bits, four megabytes, whatever it stands for.
BIT_TABLE = 25


def needed_seeds(size: np.ndarray, at_least: float) -> np.ndarray:
    """Seeds, at different words of the text, in any alignment that reaches ``at_least``, by the item's number of words.

    Of m matched words in a row m - 1 pairs are neighbours. Each pair that is no seed has lost a word of the item or gained two in the text, so
    with the cost of 1 and 2 the score leaves (4 * at_least - 1) * words / 3 - 1 seeds at the fewest.
    """
    fewest = np.ceil((4 * at_least - 1) * size / 3 - 1 - 1e-9).astype(np.int64)
    return np.where(size < LEAST_WORDS, 1, np.maximum(fewest, 1))


def longest_alignments(size: np.ndarray, at_least: float) -> np.ndarray:
    """No alignment that reaches the bound covers more words of the text: each of them without a match costs 1."""
    return np.ceil(size * (3 - 2 * at_least)).astype(np.int64) + 1


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of pairs: score, and the last word of either side in it (exclusive).

    All pairs advance together, one word of the items at a time; gaps within a row of the
    table are a running maximum.
    """
    pairs, tall, wide = len(items), max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((pairs, tall), np.uint64), np.zeros((pairs, wide), np.uint64)
    real_a, real_b = np.zeros((pairs, tall), bool), np.zeros((pairs, wide), bool)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)], real_a[k, : len(x)], real_b[k, : len(y)] = x, y, True, True
    slope = GAP * np.arange(wide + 1, dtype=np.int32)
    last = np.zeros((pairs, wide + 1), np.int32)
    best, end_a, end_b = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for i in range(tall):
        same = (b == a[:, i : i + 1]) & real_b & real_a[:, i : i + 1]
        row = np.zeros_like(last)
        np.maximum(last[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), last[:, 1:] - GAP, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        last = np.maximum.accumulate(row + slope, axis=1) - slope
        at = last.argmax(1)
        top = last[np.arange(pairs), at]
        better = top > best
        best[better], end_a[better], end_b[better] = top[better], i + 1, at[better]
    return best, end_a, end_b


def _aligned(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Rows of (score, first text word, end in the text) for each pair."""
    out = np.zeros((len(items), 3), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(texts[k])))
    begin = 0
    while begin < len(order):
        end, wide = begin, 0
        while end < len(order) and max(wide, len(texts[order[end]])) * (end - begin + 1) <= CELLS or end == begin:
            wide = max(wide, len(texts[order[end]]))
            end += 1
        group = order[begin:end]
        score, end_a, end_b = align([items[k] for k in group], [texts[k] for k in group])
        # Backwards from the end, the alignment's start is its best end.
        back, _, length = align(
            [items[k][:e][::-1] for k, e in zip(group, end_a, strict=True)], [texts[k][:e][::-1] for k, e in zip(group, end_b, strict=True)]
        ) if (end_a > 0).all() else (score, end_a, end_b)
        out[group, 0], out[group, 1], out[group, 2] = score, end_b - length, end_b
        begin = end
    return out


def digests(text: str | Column) -> list[Column]:
    """Two hashes that stand for a text; null is empty."""
    body = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return [F.xxhash64(body), F.xxhash64(F.lit("second"), body)]


def _with_digests(df: DataFrame, text: str, *others: Column) -> DataFrame:
    one, two = digests(text)
    return df.select(*others, one.alias("d1"), two.alias("d2"), F.col(text).cast("string").alias("body"))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _item_words(items: DataFrame, text: str) -> DataFrame:
    """``no, i1, i2, size, words``: one row per different item with words, hashes as eight bytes each."""

    def split(batches):
        for batch in by_bytes(batches, 2):
            words, begins = word_hashes(batch.column(2), LETTERS)
            packed = [words[a:b].astype("<u8").tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
            columns = [batch.column(0), batch.column(1), _longs(np.diff(begins)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["i1", "i2", "size", "words"])

    rows = _with_digests(items, text).dropDuplicates(["d1", "d2"]).mapInArrow(split, "i1 long, i2 long, size long, words binary")
    return materialized(rows.filter("size > 0").withColumn("no", F.monotonically_increasing_id()), "items")


def _item_seeds(items: DataFrame, at_least: float) -> DataFrame:
    """``no, at, gram, span, needed, reach``: a row per place of an item at which a seed begins."""

    def cut(batches):
        for batch in batches:
            for no, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = np.frombuffer(content.as_buffer(), "<u8").astype(np.uint64)
                span = SEED_WORDS if len(words) >= LEAST_WORDS else len(words)
                grams, size = runs_of(words, span), np.array([len(words)])
                many = len(grams)
                needed, reach = int(needed_seeds(size, at_least)[0]), int(longest_alignments(size, at_least)[0])
                columns = [np.full(many, no), np.arange(many), grams, *(np.full(many, x) for x in (span, needed, reach))]
                yield pa.RecordBatch.from_arrays([_longs(c) for c in columns], names=["no", "at", "gram", "span", "needed", "reach"])

    ddl = "no long, at long, gram long, span long, needed long, reach long"
    return materialized(items.select("no", "words").mapInArrow(cut, ddl), "item-seeds")


def _bit_table(df: DataFrame, column: str) -> np.ndarray:
    """Bits of the leading digits of a column's hashes, as 64-bit words; at most 2**(BIT_TABLE - 6) rows reach the driver."""
    bit = F.shiftrightunsigned(column, 64 - BIT_TABLE)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    rows = df.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(mask).alias("bits"))
    table = np.zeros(1 << (BIT_TABLE - 6), np.uint64)
    for word, bits in rows.collect():
        table[word] = bits & 0xFFFFFFFFFFFFFFFF
    return table


def _in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - 6 - (len(table).bit_length() - 1))
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _seed_places(column: pa.Array, table: np.ndarray, spans: list[int], part_words: int = PART_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in the row's words, hash) of the runs of words that the table lets through, part by part.

    Runs are of the lengths in ``spans``, and for pairs also of the words before and behind another.
    """
    words, begins = word_hashes(column, LETTERS)
    for begin in range(0, len(words), part_words):
        part = words[begin : begin + part_words + SEED_WORDS]
        for n in spans:
            found = [(runs_of(part, n), n)]
            if n == SEED_WORDS and len(part) > n:
                found.append((runs_of(np.stack([part[:-2], part[2:]], 1).reshape(-1), 2)[::2], n + 1))
            for grams, wide in found:
                grams = grams[:part_words]
                at = np.flatnonzero(_in_table(table, grams))
                row = np.searchsorted(begins, at + begin, "right") - 1
                inside = at + begin + wide <= begins[row + 1]
                at, row = at[inside], row[inside]
                yield row, at + begin - begins[row], grams[at]


def _seed_counts(texts: DataFrame, table, spans: list[int]) -> DataFrame:
    """``gram, n``: how often the texts hold what the table lets through."""

    def count(batches):
        for batch in by_bytes(batches, 0):
            grams = np.concatenate([np.zeros(0, np.uint64), *(g for _, _, g in _seed_places(batch.column(0), table.value, spans))])
            different, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(different), _longs(n)], names=["gram", "n"])

    return texts.select("body").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _seed_hits(texts: DataFrame, table, spans: list[int]) -> DataFrame:
    """``d1, d2, place, gram``: where the texts hold what the table lets through."""

    def find(batches):
        for batch in by_bytes(batches, 2):
            for row, place, gram in _seed_places(batch.column(2), table.value, spans):
                at = pa.array(row)
                columns = [batch.column(0).take(at), batch.column(1).take(at), _longs(place), _longs(gram)]
                yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "place", "gram"])

    return texts.select("d1", "d2", "body").mapInArrow(find, "d1 long, d2 long, place long, gram long")


def _candidates(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """``d1, d2, no, low, high``: stretches of a text with as many kept seeds of an item as an alignment there must have.

    Windows are twice as wide as the longest alignment and begin at every multiple of it, so some window holds all seeds of any
    alignment; it is the one whose first half the first seed lies in.
    """
    places = hits.join(kept, "gram").groupBy("d1", "d2", "no", "place", "still", "reach").count()
    half = F.expr("place div reach")
    windows = places.withColumn("window", F.explode(F.array(half, half - 1)))
    full = windows.groupBy("d1", "d2", "no", "window", "still", "reach").agg(
        F.count("*").alias("seeds"), F.min("place").alias("first"), F.max("place").alias("last")
    )
    full = full.filter("seeds >= still and first < (window + 1) * reach")
    low, high = F.greatest(F.col("first") - F.col("reach"), F.lit(0)), F.col("last") + F.col("reach") + 1
    return full.select("d1", "d2", "no", low.alias("low"), high.alias("high"))


def _bodies(texts: DataFrame, table) -> DataFrame:
    """``d1, d2, words`` of the texts that the table lets through; each task gives a text once."""

    def split(batches):
        seen: set[tuple[int, int]] = set()
        for batch in by_bytes(batches, 2):
            one, two = (batch.column(k).to_numpy() for k in (0, 1))
            rows = []
            for k in np.flatnonzero(_in_table(table.value, one.view(np.uint64))).tolist():
                if (this := (int(one[k]), int(two[k]))) not in seen:
                    seen.add(this)
                    rows.append(k)
            if rows:
                picked = batch.take(pa.array(rows))
                words, begins = word_hashes(picked.column(2), LETTERS)
                packed = [words[a:b].astype("<u8").tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(packed, pa.binary())], names=["d1", "d2", "words"])

    rows = texts.select("d1", "d2", "body").mapInArrow(split, "d1 long, d2 long, words binary")
    return rows.groupBy("d1", "d2").agg(F.first("words").alias("words"))


def _align_rows(batches):
    names = ["d1", "d2", "no", "score", "first_word", "end_word"]
    for batch in by_bytes(batches, 4):
        low, windows, items = batch.column(3).to_numpy(), *(
            [np.frombuffer(w.as_buffer(), "<u8").astype(np.uint64) for w in batch.column(k)] for k in (4, 5)
        )
        scored = _aligned(items, windows)
        share = scored[:, 0] / (MATCH * np.array([len(i) for i in items]))
        columns = [*(batch.column(k) for k in range(3)), pa.array(share), _longs(scored[:, 1] + low), _longs(scored[:, 2] + low)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def findings(df: DataFrame, text: str, items: DataFrame, item_text: str, at_least: float = AT_LEAST) -> DataFrame:
    """``d1, d2, i1, i2, score, first_word, end_word``: one row per different text and different item found in it, both by ``digests``."""
    spark = df.sparkSession
    texts, known = _with_digests(df, text), _item_words(items, item_text)
    seeds = _item_seeds(known, at_least)
    spans = sorted(r["span"] for r in seeds.select("span").distinct().collect())  # 1, 2 or 3
    counts = _seed_counts(texts, spark.sparkContext.broadcast(_bit_table(seeds, "gram")), spans)
    # The most frequent places of an item first; a seed that no text holds needs no row.
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc_nulls_last("n"), "at"))
    left_out = F.expr("needed div 2")
    ranked = seeds.join(counts, "gram", "left").withColumn("rank", rank)
    kept = ranked.filter((F.col("rank") > left_out) & F.col("n").isNotNull())
    kept = materialized(kept.select("gram", "no", (F.col("needed") - left_out).alias("still"), "reach").distinct(), "seed-table")
    hits = _seed_hits(texts, spark.sparkContext.broadcast(_bit_table(kept, "gram")), spans)
    candidates = materialized(_candidates(hits, kept), "candidates")
    bodies = _bodies(texts, spark.sparkContext.broadcast(_bit_table(candidates, "d1")))
    window = F.expr("substring(words, int(8 * low + 1), int(8 * (high - low)))")
    stretches = candidates.join(bodies, ["d1", "d2"]).select("d1", "d2", "no", "low", window.alias("window"))
    pairs = stretches.join(known.select("no", F.col("words").alias("item")), "no").select("d1", "d2", "no", "low", "window", "item")
    scored = pairs.mapInArrow(_align_rows, "d1 long, d2 long, no long, score double, first_word long, end_word long")
    # Of equal scores, the first place.
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("best")
    found = scored.filter(F.col("score") >= at_least).groupBy("d1", "d2", "no").agg(best)
    return materialized(found.join(known.select("no", "i1", "i2"), "no").select("d1", "d2", "i1", "i2", "best.*"), "findings")


def contaminated(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, at_least: float = AT_LEAST) -> DataFrame:
    """``key, item, score, first_word, end_word``: one row per text and item found in it, with its best place.

    ``score`` is the alignment's share of a perfect copy's, from ``at_least`` to 1; words are runs of
    letters and digits, without case, and are counted from 0. Null, empty and wordless texts and items are found nowhere and contain nothing.
    Rows that repeat, or have a null key, are reported one by one; items that repeat are reported each. Empty tables give no rows, and
    only the named columns are read. Texts and items may be of any length and number, and are found
    wherever the alignment reaches ``at_least``, if that is a half or more.
    """
    found = findings(df, text, items, item_text, at_least)
    rows = _with_digests(df, text, F.col(key).alias("key")).drop("body")
    asked = _with_digests(items, item_text, F.col(item_key).alias("item")).drop("body").withColumnsRenamed({"d1": "i1", "d2": "i2"})
    return rows.join(found, ["d1", "d2"]).join(asked, ["i1", "i2"]).select(F.col("key").alias(key), "item", "score", "first_word", "end_word")


def uncontaminated(df: DataFrame, text: str, items: DataFrame, item_text: str, at_least: float = AT_LEAST) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text holds no item; see ``contaminated``.

    A row stays or goes by its text alone: null and shared keys change nothing, and rows that repeat share their fate.
    """
    found = findings(df, text, items, item_text, at_least).select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).distinct()
    one, two = digests(text)
    return df.join(found, (one == F.col("_d1")) & (two == F.col("_d2")), "left_anti")
