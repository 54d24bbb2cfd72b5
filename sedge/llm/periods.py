"""Periodic runs of words inside texts, and the texts without the repeats.

A run is a stretch of words with smallest period q that cannot be made longer. By the runs theorem every run of at least
two periods shows itself as a Lyndon word: under one of the two orders of the alphabet, the longest Lyndon word that begins
at each of its roots has length q. The steps for a text:

1. runs of ``m`` words that occur once cannot be inside a run that is long enough (``common_words``), so only stretches
   of repeated ones go on;
2. the first phase of Baier's suffix sorting puts the places of a stretch into groups and leaves every place with the length of
   its longest Lyndon word, once for either order (``lyndon_lengths``);
3. where a Lyndon word is followed by one of the same length (as it must be in a run of three periods), the two are extended to
   both sides by longest common extensions.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.hashing import STEP, WHITE_SPACE, Alphabet, mix, runs_of, word_hashes
from sedge.llm.slicing import by_bytes

LEAST_WORDS, LEAST_PERIODS = 24, 3
# Words compared at once when a root is extended; doubled as long as they agree.
FIRST_STEP = 64
# White space separates; capitals count as letters of their own.
CASED = Alphabet(WHITE_SPACE.separator, np.random.default_rng(0xCA5E).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), latin=False)


def lyndon_lengths(letters: list[int], alphabet: int) -> list[int]:
    """For each place, the length of the longest Lyndon word that begins there; letters are 0 to ``alphabet`` - 1, all of them in use.

    Places start in groups by letter. Groups are taken from the greatest down: each member points to the nearest place
    before it that lies in a smaller group, and such places move to a new group just above their own, in which the
    taken group's word is appended as often as they were pointed to. No later group is ever above the one taken, so each place
    points once, and ends in the group of its Lyndon word.
    """
    n = len(letters)
    group = [0, *(x + 1 for x in letters)]
    members: list[list[int]] = [[] for _ in range(alphabet + 1)]
    for place in range(1, n + 1):
        members[group[place]].append(place)
    length = [1] * (alphabet + 1)
    below, above = [-1, *range(alphabet)], [*range(1, alphabet + 1), -1]
    # The nearest place at or before each that lies in a group not yet taken; place 0 stands for none.
    open_at = list(range(n + 1))
    taken = alphabet
    while taken > 0:
        own = [i for i in members[taken] if group[i] == taken]
        members[taken] = own
        for i in own:
            open_at[i] = i - 1
        pointed: dict[int, int] = {}
        for i in own:
            at = i - 1
            while (ahead := open_at[at]) != at:
                open_at[at] = at = open_at[ahead]
            open_at[i] = at
            if at:
                pointed[at] = pointed.get(at, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for place, times in pointed.items():
            moves.setdefault((times, group[place]), []).append(place)
        for times, old in sorted(moves, reverse=True):
            new, moved, up = len(members), moves[times, old], above[old]
            members.append(moved)
            length.append(length[old] + times * length[taken])
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
            for place in moved:
                group[place] = new
        taken = below[taken]
    return [length[g] for g in group[1:]]


def _agreement(one: np.ndarray, other: np.ndarray) -> int:
    """How many leading values of two arrays agree."""
    n, at, step = min(len(one), len(other)), 0, FIRST_STEP
    while at < n:
        differ = one[at : at + step] != other[at : at + step] if at + step <= n else one[at:n] != other[at:n]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + step, 2 * step
    return n


def runs_in(words: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one sequence that have ``least`` words and ``times`` periods, by start, then period."""
    n = len(words)
    if n < max(least, times):
        return []
    _, letters = np.unique(words, return_inverse=True)
    alphabet, places, found = int(letters.max()) + 1, np.arange(n), set()
    for order in (letters, alphabet - 1 - letters):
        roots = np.array(lyndon_lengths(order.tolist(), alphabet))
        follow = places + roots
        good = np.flatnonzero((follow < n) & (times * roots <= n))
        if times > 2:  # then a second root follows one of them whole
            good = good[(follow[good] + roots[good] <= n) & (roots[follow[good]] == roots[good]) & (words[follow[good]] == words[good])]
        good = good[np.lexsort((good, roots[good]))]
        last, upto = 0, 0
        for i, q in zip(good.tolist(), roots[good].tolist(), strict=True):
            if q == last and i + q <= upto:
                continue
            end = i + q + _agreement(words[i:], words[i + q :])
            start = i - (_agreement(words[:i][::-1], words[: i + q][::-1]) if i else 0)
            if end - start >= 2 * q:
                last, upto = q, end
                if end - start >= max(least, times * q):
                    found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def common_words(least: int, times: int) -> int:
    """The greatest m such that any m neighbouring words of a long enough run occur in it a second time."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 2)))


def _repeated_stretches(words: np.ndarray, begins: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of words, each within one row, that hold all long enough runs: every m words occur twice in their stretch."""
    m = common_words(least, times)
    edges = np.stack([begins[:-1], begins[1:]], 1)
    edges = edges[edges[:, 1] - edges[:, 0] >= least]
    grams = runs_of(words, m)
    while len(edges):
        counts = edges[:, 1] - edges[:, 0] - m + 1
        owner = np.repeat(np.arange(len(edges)), counts)
        at = np.arange(len(owner)) + np.repeat(edges[:, 0] - (np.cumsum(counts) - counts), counts)
        keys = mix(grams[at] + owner.astype(np.uint64) * STEP)
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return []
        here = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        kept = twice[here] == keys
        if kept.all():
            break
        at, owner = at[kept], owner[kept]
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        edges = np.stack([at[first], at[last] + m], 1)
        edges = edges[edges[:, 1] - edges[:, 0] >= least]
    return [tuple(e) for e in edges.tolist()]


def text_runs(column: pa.Array, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """Words per row, and the runs of the rows that have any."""
    words, begins = word_hashes(column, CASED)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in _repeated_stretches(words, begins, least, times):
        row = int(np.searchsorted(begins, begin, "right")) - 1
        base = begin - int(begins[row])
        if runs := runs_in(words[begin:end], least, times):
            found.setdefault(row, []).extend((base + s, n, q) for s, n, q in runs)
    return np.diff(begins), {row: sorted(runs, key=lambda r: (r[0], r[2])) for row, runs in found.items()}


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat an earlier period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def periodic_runs(df: DataFrame, key: str, text: str, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """``key, n_words, runs, collapsed``: one row per row.

    ``runs`` is an array of (start, length, period) in words from 0, by start, then period: every run of at least ``least`` words
    and ``times`` (two or more) periods. ``collapsed`` keeps the words that no run contains after its first period, joined by one space.
    Words are separated by ASCII white space and keep their case. Null, empty and wordless texts have no runs and collapse to
    the empty string; rows that repeat and null keys are kept; an empty table gives no rows; other columns are not read.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = df.select(key).schema[0].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches):
        for batch in by_bytes(batches, 1):
            counts, found = text_runs(batch.column(1), least, times)
            flat = np.array([r for row in sorted(found) for r in found[row]], np.int64).reshape(-1, 3)
            many = np.zeros(len(batch) + 1, np.int32)
            for row, runs in found.items():
                many[row + 1] = len(runs)
            runs = pa.ListArray.from_arrays(
                pa.array(np.cumsum(many, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type))
            )
            texts = [
                collapsed((body or b"").split(), found.get(row, [])) for row, body in enumerate(batch.column(1).cast(pa.binary()).to_pylist())
            ]
            columns = [batch.column(0), pa.array(counts.astype(np.int64)), runs, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "runs", "collapsed"])

    ddl = f"`{key}` {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(search, ddl)
