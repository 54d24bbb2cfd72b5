"""Near duplicates by a join of parity sketches.

A text's set is its distinct five-word shingles, as 64-bit hashes. Its sketch is a bit vector in which every
shingle flips one bit, so the Hamming distance of two sketches never exceeds the symmetric difference of
the sets. The vector is so long that it is kept as its set bits, cut into K blocks; a block's bits are told
apart by their XOR.

Two sets link at Jaccard 0.8 only if their symmetric difference is at most (|A|+|B|)/9 =: k. A difference touches one
block, so a set with more than k non-empty blocks shares at least one of them, unchanged, with every
set it links with. K follows from a size band such that this holds (K ~ 0.32 of the band's
upper size); texts near a band's end also join the next band.

Blocks that few texts share give all their pairs. Blocks that many texts share (a passage found everywhere, a large family of copies) give
none; a text that keeps more than k other blocks loses nothing by that, since every link of its
shows up there as well. What is left are pairs of texts that both consist mostly of shared blocks.
Those texts are joined exactly by another way: each first meets the text that is most typical of
its family, which connects most of a family with one comparison a text; and then their rarest shingles
(a prefix that two linked sets must share) bring together only texts of different components.

Candidates whose short sketches differ by more than k are dropped; the others are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.graph import components
from sedge.llm.hashing import mix, shingle_sets
from sedge.llm.scratch import materialized

WORDS = 5
# Blocks per shingle of a band's largest set; blocks shared by more texts than FEW are left to the second way.
BLOCKS = 0.32
FEW = 16
# Signatures gathered by a task, and rare-shingle entries compared at once.
TASK_SIGNATURES = 2_000_000
TASK_ENTRIES = 4_000
SIGNATURE_SHARE = 0.6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def set_class(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed integer: sets are one class if it and their size agree."""
    if not len(shingles):
        return 0
    folded = np.array([np.bitwise_xor.reduce(mix(shingles)), shingles.sum(), len(shingles)], np.uint64)
    return int(mix(folded[:1] + mix(folded[1:2] + mix(folded[2:])))[0].astype(np.int64))


def band_of(size: int) -> int:
    """Bands double: 1, 2-3, 4-7, ..."""
    return size.bit_length() - 1


def blocks_of(band: int) -> int:
    return max(1, int(np.ceil(BLOCKS * (2 << band))))


def signatures(shingles: np.ndarray, band: int) -> np.ndarray:
    """A number for each non-empty block of a set's sketch: band, block, and XOR of the block's bits."""
    blocks = blocks_of(band)
    place = (shingles >> np.uint64(32)) % np.uint64(blocks)
    order = np.argsort(place, kind="stable")
    place, bits = place[order], mix(shingles[order] + GOLDEN)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return mix(np.bitwise_xor.reduceat(bits, starts) ^ mix(place[starts] * GOLDEN + np.uint64(band)))


def set_signatures(shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(margin, signatures) in each band that the set joins.

    The margin is how many non-empty blocks there are beyond the most that a linked set can change.
    """
    size, band = len(shingles), band_of(len(shingles))
    for at in [band] + [band + 1] * (5 * size >= 4 * (2 << band)):
        own = signatures(shingles, at)
        yield len(own) - size // 4, own


def sketch(shingles: np.ndarray) -> bytes:
    """The parity sketch in one to two bits a shingle: each flips the bit that its hash names."""
    if not len(shingles):
        return b""
    bits = max(64, 2 << band_of(len(shingles)))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, which the symmetric difference cannot be below. The longer one is folded by XOR."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, n, c, sketch``: size, class and sketch of every row's set."""

    def digest(batches):
        for batch in batches:
            found = [(len(s), set_class(s), sketch(s)) for s in shingle_sets(batch.column(1), WORDS)]
            n, c, bits = (pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, c, bits], names=["doc", "n", "c", "sketch"])

    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("body"))
    return rows.mapInArrow(digest, f"doc {dict(df.dtypes)[key]}, n long, c long, sketch binary")


def _within_reach(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave a link possible."""

    def compare(batches):
        for batch in batches:
            a, b, p, q, x, y = (batch.column(k) for k in range(6))
            size = p.to_numpy() + q.to_numpy()
            most = size * (100 - percent) // (100 + percent)
            near = np.abs(p.to_numpy() - q.to_numpy()) <= most
            for k in np.flatnonzero(near).tolist():
                near[k] = least_difference(x[k].as_py(), y[k].as_py()) <= most[k]
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = sketches.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("of_a"))
    right = sketches.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")
    return both.mapInArrow(compare, "a long, b long")


def _signature_parts(df: DataFrame, text: str, parts: int) -> DataFrame:
    """Signatures dealt over ``parts``: packed (signature, owner) pairs with the owners' (class, margin) records.

    A class that a task has met before is not sent again. Of a block that more than FEW classes of a batch share, so
    many are sent that every task sees it is common; the others are told so at once (``told``: class, margin,
    number of such blocks). So no block, however common, makes a large group anywhere.
    """

    def pack(batches):
        sent: set[int] = set()
        for batch in batches:
            keys, owners, records = [], [], []
            for shingles in shingle_sets(batch.column(0), WORDS):
                if not len(shingles) or (own := set_class(shingles)) in sent:
                    continue
                sent.add(own)
                for which, (margin, values) in enumerate(set_signatures(shingles)):
                    keys.append(values)
                    owners.append(np.full(len(values), len(records), np.int32))
                    records.append((own, 2 * margin + which))
            if not records:
                continue
            key, owner, record = np.concatenate(keys), np.concatenate(owners), np.array(records, np.int64)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            nth = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
            told = np.bincount(owner[nth > FEW], minlength=len(record))
            key, owner = key[nth <= FEW], owner[nth <= FEW]
            some = np.flatnonzero(told)
            extra = np.column_stack([record[some], told[some]]).astype(np.int64).tobytes()
            # Parts are ranges of signatures, so they lie one behind the other.
            part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for number in range(parts):
                a, b = cuts[number], cuts[number + 1]
                if a < b:
                    used, short = np.unique(owner[a:b], return_inverse=True)
                    packed = [key[a:b].tobytes(), short.astype(np.int32).tobytes(), record[used].tobytes(), extra]
                    extra = b""
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=names)

    names = ["part", "keys", "owners", "records", "told"]
    return df.select(text).mapInArrow(pack, "part int, keys binary, owners binary, records binary, told binary")


def _shared_blocks(parts: DataFrame, number: int) -> DataFrame:
    """Candidates and counts: (a, b) for two classes that share a rare block; (a, margin, heavy) for a class's common blocks."""
    ddl = "a long, b long, margin long, heavy long"
    names = ["a", "b", "margin", "heavy"]

    def emit(a, b=None, margin=None, heavy=None):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x) if x is not None else none for x in (a, b, margin, heavy)], names=names)

    def match(batches):
        keys, owners, records, base = [], [], [], 0
        for batch in batches:
            for key, owner, record, extra in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if extra:
                    told = np.frombuffer(extra, np.int64).reshape(-1, 3)
                    yield emit(*(np.ascontiguousarray(told[:, k]) if k >= 0 else None for k in (0, -1, 1, 2)))
                keys.append(np.frombuffer(key, np.uint64))
                owners.append(np.frombuffer(owner, np.int32) + base)
                records.append(np.frombuffer(record, np.int64).reshape(-1, 2))
                base += len(records[-1])
        if not keys:
            return
        # The same class may come from several tasks.
        record, same = np.unique(np.concatenate(records), axis=0, return_inverse=True)
        owner, key = same.reshape(-1)[np.concatenate(owners)], np.concatenate(keys)
        order = np.lexsort((owner, key))
        owner, key = owner[order], key[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        owner, key = owner[fresh], key[fresh]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        rare = np.repeat(size <= FEW, size)
        c, margin = record[:, 0], record[:, 1]
        heavy = np.bincount(owner[~rare], minlength=len(record))
        told = np.flatnonzero((heavy > 0) | (margin < 2))
        yield emit(c[told], margin=margin[told], heavy=heavy[told])
        shared = rare & np.repeat(size > 1, size)
        owner, key = owner[shared], key[shared]
        pairs = [np.zeros((0, 2), np.int64)]
        for step in range(1, FEW):
            at = np.flatnonzero(key[step:] == key[:-step])
            if not len(at):
                break
            two = c[np.stack([owner[at], owner[at + step]], 1)]
            pairs.append(np.unique(np.sort(two, 1), axis=0))
        two = np.unique(np.concatenate(pairs), axis=0)
        two = two[two[:, 0] != two[:, 1]]
        for k in range(0, len(two), 100_000):
            yield emit(np.ascontiguousarray(two[k : k + 100_000, 0]), b=np.ascontiguousarray(two[k : k + 100_000, 1]))

    return parts.repartition(number, "part").mapInArrow(match, ddl)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Jaccard of two sorted sets, in whole numbers."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (low + high - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""

    def verify(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([linked(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("of_b"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return sized.mapInArrow(verify, "a long, b long")


def _whole_sets(df: DataFrame, key: str, text: str, classes: DataFrame) -> DataFrame:
    """``c, shingles`` of the wanted ``classes(rep, c)``, from the text of one row each."""

    def build(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(0), WORDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_class(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["c", "shingles"]
            )

    texts = df.select(F.col(key).alias("rep"), F.col(text).alias("body")).join(classes.select("rep").distinct(), "rep", "left_semi")
    return texts.select("body").mapInArrow(build, "c long, shingles binary").dropDuplicates(["c"])


def _typical_pairs(sets: DataFrame) -> DataFrame:
    """Each of the given texts with the two texts that are most typical of what it contains.

    A text is the more typical the more common its shingles are. Each shingle names the most typical of its texts,
    and a text meets the two that most of its shingles name.
    """
    long = _exploded(sets)
    common = long.groupBy("t").agg(F.count("*").alias("f"))
    rated = long.join(common.filter("f > 1"), "t")
    rank = rated.groupBy("c").agg(F.sum(F.log("f")).alias("sum")).join(sets.select("c", "n"), "c").select("c", (F.col("sum") / F.col("n")).alias("typical"))
    with_rank = long.join(rank, "c")
    heads = with_rank.groupBy("t").agg(F.max(F.struct("typical", "c")).alias("head")).select("t", F.col("head.c").alias("head"))
    votes = long.join(heads, "t").filter("head != c").groupBy("c", "head").count()
    best = votes.groupBy("c").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("count", "head")))), 1, 2).alias("best"))
    pairs = best.select("c", F.explode("best").alias("b"))
    return pairs.select(F.least("c", "b.head").alias("a"), F.greatest("c", "b.head").alias("b")).distinct()


def _exploded(sets: DataFrame) -> DataFrame:
    """``c, t``: one row per shingle."""

    def split(batches):
        for batch in batches:
            values = [np.frombuffer(v, np.int64) for v in batch.column(1).to_pylist()]
            for k, v in enumerate(values):
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(v)), pa.array(v)], names=["c", "t"])

    return sets.select("c", "shingles").mapInArrow(split, "c long, t long")


def _rare_pairs(sets: DataFrame, labels: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs of different components that can link, by their common rarest shingle.

    In a fixed order of shingles, rarest first, the first common shingle of two linked sets has at most k shingles of
    both before it, so it is in the first n - ceil(0.8 n) + 1 of either. A shingle with many texts
    is dealt out as pairs of groups of texts.
    """
    long = _exploded(sets)
    common = long.groupBy("t").agg(F.count("*").alias("f"))
    ordered = (
        long.join(common, "t")
        .groupBy("c")
        .agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ts"))
        .select("c", F.size("ts").alias("n"), "ts")
    )
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    entries = ordered.select("c", "n", F.posexplode(F.slice("ts", F.lit(1), prefix.cast("int"))).alias("at", "ft")).select(
        F.col("ft.t").alias("t"), "c", "n", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n_long")
    )
    entries = entries.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").select(
        "t", "c", "n_long", "at", F.coalesce("label", "c").alias("label")
    )
    shared = entries.groupBy("t").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    shared = shared.filter("lo != hi").select("t", F.ceil(F.col("m") / TASK_ENTRIES).alias("groups"))
    dealt = (
        entries.join(shared, "t")
        .withColumn("own", F.pmod(F.xxhash64("c"), F.col("groups")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        .select(F.xxhash64("t", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "t", "c", "n_long", "at", "label")
    )

    def match(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        cell, t, c, n, at, label = (table.column(k).to_numpy() for k in range(6))
        order = np.lexsort((c, t, cell))
        cell, t, c, n, at, label = (x[order] for x in (cell, t, c, n, at, label))
        cuts = np.r_[np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (t[1:] != t[:-1])]), len(cell)]
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if label[a:b].min() == label[a:b].max():
                continue
            for x in range(a, b):
                ahead = slice(x + 1, b)
                most = (n[x] + n[ahead]) * (100 - percent) // (100 + percent)
                good = (label[ahead] != label[x]) & (at[x] + at[ahead] + np.abs(n[x] - at[x] - n[ahead] + at[ahead]) <= most)
                if good.any():
                    others = c[ahead][good]
                    found.append(np.stack([np.minimum(others, c[x]), np.maximum(others, c[x])], 1))
        two = np.unique(np.concatenate(found), axis=0)
        two = two[two[:, 0] != two[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(two[:, k])) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition(tasks, "cell").mapInArrow(match, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id`` of every row.

    Rows link when 100 * intersection >= percent * union of their sets (``percent`` from 80); ``component_id`` is the smallest key
    that links reach. Null and empty texts have no shingles and are alone. Rows with equal sets are one class,
    which is compared once. A row with a null key is returned with its size, and null for its
    component; it links with nothing. An empty table gives no rows; other columns are not read.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the sketches' bands are laid out for 80 percent and more")
    spark = df.sparkSession
    tasks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = materialized(_sets_table(df, key, text), "sets")
    classes = docs.filter("doc is not null and n > 0").groupBy("c").agg(F.min("doc").alias("rep"), F.max("n").alias("n"))
    total = docs.agg(F.sum("n")).first()[0] or 0
    number = max(tasks, int(total * SIGNATURE_SHARE / TASK_SIGNATURES) + 1)
    keyed = df.filter(F.col(key).isNotNull())
    shared = materialized(_shared_blocks(_signature_parts(keyed, text, number), number), "blocks")
    sketches = docs.join(classes.select(F.col("rep").alias("doc"), "c"), ["doc", "c"]).select("c", "n", "sketch").dropDuplicates(["c"])
    sketches = materialized(sketches, "sketches")
    candidates = shared.filter("b is not null").select("a", "b").distinct()
    pairs = materialized(_within_reach(candidates, sketches, percent), "pairs")
    # A margin is stored doubled, with the band's turn in its last bit.
    heavy = (
        shared.filter("b is null").groupBy("a", "margin").agg(F.sum("heavy").alias("heavy"))
        .filter("heavy >= floor(margin / 2)").select(F.col("a").alias("c")).distinct()
    )
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).unionByName(heavy).distinct()
    sets = materialized(_whole_sets(df, key, text, classes.join(wanted, "c")), "wanted-sets")
    links = materialized(_verified(pairs, sets, percent), "verified")

    heavy_sets = sets.join(heavy, "c", "left_semi").withColumn("n", (F.octet_length("shingles") / 8).cast("long"))
    heavy_sets = materialized(heavy_sets, "heavy-sets")
    if not heavy_sets.isEmpty():
        typical = _verified(_typical_pairs(heavy_sets), heavy_sets, percent)
        links = materialized(links.unionByName(typical), "verified")
        labels = materialized(components(links), "labels")
        rest = _verified(_rare_pairs(heavy_sets, labels, percent, tasks), heavy_sets, percent)
        # What is still missing connects components, so their labels are the nodes.
        of = labels.select(F.col("node"), F.col("label"))
        bridges = (
            rest.join(of.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a", "left")
            .join(of.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b", "left")
            .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        )
        joined = components(bridges).withColumnRenamed("label", "root")
        everyone = labels.unionByName(joined.select("node", F.col("node").alias("label"))).distinct()
        ranked = everyone.groupBy("node").agg(F.min("label").alias("label"))
        labels = ranked.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    else:
        labels = components(links)
    labels = materialized(labels, "labels")
    lowest = labels.join(classes, labels["node"] == classes["c"]).groupBy("label").agg(F.min("rep").alias("lowest"))
    answer = (
        classes.join(labels, classes["c"] == labels["node"], "left").join(lowest, "label", "left")
        .select("c", F.coalesce("lowest", "rep").alias("component"))
    )
    return docs.drop("sketch").join(answer, "c", "left").select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component"))).alias("component_id"),
    )


def one_of_each(df: DataFrame, key: str, text: str, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay: of each component the row with the smallest key, with all its columns.

    A row is known by its key and text together, so a different text that shares its key with a near copy is judged by itself, and of a
    component's texts that share the smallest key one stays; rows equal in both share their fate. Rows with a null key stay.
    """
    keyed = df.filter(F.col(key).isNotNull())
    row = F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))
    rows = keyed.select(row.alias("row"), F.col(key).alias("key"), F.col(text).alias("body"))
    found = near_duplicates(rows.select("row", "body"), "row", "body", percent)
    held = found.select("row", "component_id").join(rows.select("row", "key"), "row").groupBy("component_id")
    stays = held.agg(F.min(F.struct("key", "row")).alias("best")).select(F.col("best.row").alias("_row"))
    kept = keyed.withColumn("_row", row).join(stays, "_row", "left_semi").drop("_row")
    return kept.unionByName(df.filter(F.col(key).isNull()))
