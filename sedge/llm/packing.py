"""Best-fit packing of token pieces by a configuration linear program.

The program has one demand per piece length and one column per way to fill a
sequence. It never sees pieces, only their length histogram, so it is the same size for any
number of documents:

1. multiplicative weights hold one price per length; a knapsack table over the capacity finds
   the dearest fillings; lengths that are covered early get cheaper;
2. the columns' counts are rounded down, never beyond the demand;
3. what is left is put best-fit, longest first, also on counts.

The plan is a list of fillings with counts. Pieces find their place in it by their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.scratch import materialized
from sedge.llm.tokens import word_tokens

RANK_BITS = 44


def prices_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each capacity and the length put last (0: one unit left empty).

    ``weights[l]`` is the price of length l, at most 0 where l is not asked for.
    """
    limit = len(weights) - 1
    best, last = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    prices = weights[1:]
    for room in range(1, limit + 1):
        values = best[room - 1 :: -1][:room] + prices[:room] if room > 1 else best[:1] + prices[:1]
        at = int(values.argmax())
        if values[at] > best[room - 1] and prices[at] > 0:
            best[room], last[room] = values[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, last


def filling(last: np.ndarray, room: int) -> list[int]:
    """The lengths that the table puts into a capacity."""
    out = []
    while room > 0:
        if take := int(last[room]):
            out.append(take)
            room -= take
        else:
            room -= 1
    return out


def covering_columns(demand: np.ndarray, rounds: int, columns: int, slack: float = 0.02) -> dict[tuple[int, ...], float]:
    """Fractional counts of fillings that about cover the demand, by multiplicative weights.

    Each round spends an equal part of the least possible number of sequences on the
    ``columns`` fillings with the most uncovered demand whose price is within ``slack`` of the best.
    """
    limit = len(demand) - 1
    lengths = np.arange(limit + 1)
    least = float((lengths * demand).sum()) / limit
    covered = np.zeros(limit + 1)
    asked = demand > 0
    spent: dict[tuple[int, ...], float] = defaultdict(float)
    for turn in range(rounds):
        share = np.divide(covered, demand, out=np.zeros(limit + 1), where=asked)
        gain = np.exp(np.clip(4.0 * (turn / rounds - share), -30, 30))
        weights = np.where(asked & (share < 1), lengths * gain, 0.0)
        if not weights.any():
            break
        best, last = prices_table(weights)
        value = np.where(weights > 0, weights + best[limit - lengths], 0.0)
        near = np.flatnonzero(value >= (1 - slack) * value.max())
        open_demand = np.maximum(demand - covered, 0)
        near = near[np.argsort(-open_demand[near], kind="stable")][:columns]
        parts = open_demand[near] / open_demand[near].sum()
        for length, part in zip(near.tolist(), parts.tolist(), strict=True):
            column = tuple(sorted([length, *filling(last, limit - length)], reverse=True))
            amount = part * least / rounds
            spent[column] += amount
            for item in column:
                covered[item] += amount
    return spent


def best_fit_counts(demand: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts per length: fillings and how often each is used."""
    limit = len(demand) - 1
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(content: tuple[int, ...], bins: int, room: int) -> None:
        if bins:
            rooms[room].append((content, bins))

    for length in range(limit, 0, -1):
        left = int(demand[length])
        for room in sorted(r for r in rooms if r >= length):
            if not left:
                break
            fits = room // length
            groups, rooms[room] = rooms[room], []
            for content, bins in groups:
                full = min(bins, left // fits)
                put(content + (length,) * fits, full, room - fits * length)
                left -= full * fits
                rest = left if full < bins and left < fits else 0
                if rest:
                    put(content + (length,) * rest, 1, room - rest * length)
                    left = 0
                put(content, bins - full - bool(rest), room)
        if left:
            fits = limit // length
            put((length,) * fits, left // fits, limit - fits * length)
            if rest := left % fits:
                put((length,) * rest, 1, limit - rest * length)
    return [group for groups in rooms.values() for group in groups]


def packing_plan(demand: np.ndarray, rounds: int = 48, columns: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with counts that hold exactly ``demand[l]`` pieces of each length l."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    limit = len(demand) - 1
    if left[limit]:
        plan.append(((limit,), int(left[limit])))
        left[limit] = 0
    spent = covering_columns(left.astype(float), rounds, columns) if left.any() else {}
    for column, amount in sorted(spent.items(), key=lambda c: (-sum(c[0]), -c[1], c[0])):
        need = np.bincount(column, minlength=limit + 1)
        held = np.flatnonzero(need)
        count = min(int(amount), int((left[held] // need[held]).min()))
        if count > 0:
            left -= need * count
            plan.append((column, count))
    return plan + best_fit_counts(left)


@dataclass(frozen=True)
class Places:
    """Where the r-th piece of a length goes: runs of ranks, sorted by (length, first rank)."""

    starts: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, plan: list[tuple[tuple[int, ...], int]]) -> "Places":
        rank: dict[int, int] = defaultdict(int)
        runs, base = [], 0
        for content, count in plan:
            at = 0
            for length in content:
                runs.append(((length << RANK_BITS) + rank[length], base, at))
                rank[length] += count
                at += length
            base += count
        runs.sort()
        table = np.array(runs, np.int64).reshape(-1, 3)
        return cls(table[:, 0], table[:, 1], table[:, 2])

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = (length.astype(np.int64) << RANK_BITS) + rank
        at = np.searchsorted(self.starts, code, "right") - 1
        return self.sequence[at] + code - self.starts[at], self.offset[at]


def token_pieces(
    df: DataFrame, key: str, text: str, vocabulary: str, limit: int = 2048, separator: int = 0, with_ids: bool = False
) -> DataFrame:
    """``doc, piece, start, length, ids_crc32, part, nth`` (and ``ids``): each document's ids, then the separator, cut at ``limit``.

    ``part`` is the task that made the piece and ``nth`` counts its pieces of the same length.
    Both hold only for one run of the plan: write the table before using them.
    """
    fields = [
        pa.field("doc", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()),
        pa.field("ids_crc32", pa.int64()), pa.field("part", pa.int32()), pa.field("nth", pa.int64()),
    ]
    ddl = "doc long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    if with_ids:
        fields.append(pa.field("ids", pa.binary()))
        ddl += ", ids binary"
    schema, width = pa.schema(fields), 4 * limit

    def cut(batches):
        tokens, part = word_tokens(vocabulary), TaskContext.get().partitionId()
        seen, end = [0] * (limit + 1), int(separator).to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for row in range(batch.num_rows):
                doc, ids = batch.column(0)[row].as_py(), tokens.encode(batch.column(1)[row].as_py()) + end
                for number, at in enumerate(range(0, len(ids), width)):
                    content = ids[at : at + width]
                    length = len(content) // 4
                    values = (doc, number, at // 4, length, zlib.crc32(content), part, seen[length], content)
                    seen[length] += 1
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, fields, strict=True)], schema=schema)

    return df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("body")).mapInArrow(cut, ddl)


def pack(df: DataFrame, key: str, text: str, vocabulary: str, limit: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their place: ``sequence_id, offset`` beside the columns of ``token_pieces``.

    Null and empty texts give one piece that holds the separator alone. A text longer than a
    sequence is cut into full pieces and a rest. Repeated rows are packed as often as they occur,
    null identifiers are kept, an empty table gives no rows, other columns are not read. Offsets in a
    sequence are gapless from 0; numbers of sequences are 0 and up.

    To the driver goes the histogram (``limit`` numbers at most); to the tasks go the
    plan's runs of ranks, whose number depends on ``limit`` and the rounds alone.
    """
    pieces = materialized(token_pieces(df, key, text, vocabulary, limit, separator, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    demand = np.zeros(limit + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        demand[length] = n
    places = df.sparkSession.sparkContext.broadcast(Places.of(packing_plan(demand)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        *[c for c in pieces.columns if c not in ("part", "nth")], (F.col("base") + F.col("nth")).alias("rank")
    )
    names = [c for c in ranked.columns if c != "rank"]
    kept = ", ".join(f"{c} {dict(ranked.dtypes)[c]}" for c in names)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.value.find(length, rank)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long").withColumnRenamed("doc", key)
