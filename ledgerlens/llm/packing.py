"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

A document's tokens are cut only where it is longer than a sequence. What has to be packed is then a
histogram of piece lengths, at most one count per length, and all decisions are taken on it:

* ``reduce_instance`` fixes, after Martello and Toth, small sets that some optimal packing contains: a piece
  that nothing else fits beside; a pair that fills a sequence exactly; a pair {j, k} with k the longest
  piece that fits beside j, where no two pieces fit beside j; a triple {j, a, b} where no three fit beside
  j, a is the longest that fits, and b is at least the shorter member of every pair that fits.
* ``best_fit`` packs the rest, longest first, each into the fullest sequence that has room; equal sequences
  are handled as one group.

Both give groups of identical sequences. A piece finds its place from its length and its rank among the
pieces of that length: a table of rank intervals, bounded by the number of lengths and not by the data,
goes to all tasks. Ranks come from per-task counts, so no length's pieces ever meet in one task.

Cases: a null or empty text has only its end id. Equal documents are packed one by one. An empty table gives
an empty result. Extra columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .word_ids import REMEMBERED, word_ids

CAPACITY = 2048

#: A group: how many sequences, and the (length, times) of each one's pieces from the start on.
Group = tuple[int, tuple[tuple[int, int], ...]]


def _smallest(count: np.ndarray, k: int) -> list[int]:
    """The k smallest remaining pieces, with repetition."""
    out: list[int] = []
    for s in np.flatnonzero(count)[:k].tolist():
        out += [s] * int(min(count[s], k - len(out)))
        if len(out) == k:
            break
    return out


def _longest(count: np.ndarray, limit: int) -> int:
    """The longest remaining piece of at most limit, or 0."""
    found = np.flatnonzero(count[: max(limit, 0) + 1])
    return int(found[-1]) if len(found) else 0


def reduce_instance(count: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Fix dominating sets; count (by length) is reduced in place."""
    fixed: list[Group] = []

    def fix(*pieces: int) -> None:
        need = {p: pieces.count(p) for p in pieces}
        n = min(int(count[p]) // t for p, t in need.items())
        for p, t in need.items():
            count[p] -= n * t
        fixed.append((n, tuple((p, 1) for p in pieces)))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                rest = capacity - j
                count[j] -= 1  # the others, without this piece
                low, k = _smallest(count, 3), _longest(count, rest)
                chosen = None
                if k == 0:
                    chosen = (j,)
                elif k == rest or len(low) < 2 or low[0] + low[1] > rest:
                    chosen = (j, k)
                elif len(low) < 3 or sum(low) > rest:
                    chosen = _triple(count, j, k, rest)
                count[j] += 1
                if chosen is None:
                    break
                fix(*chosen)
                changed = True
    return fixed


def _triple(count: np.ndarray, j: int, a: int, rest: int) -> tuple[int, ...] | None:
    """{j, a, b} where it dominates every set that fits beside j; at most two pieces do."""
    count[a] -= 1
    b = _longest(count, rest - a)
    count[a] += 1
    t = rest // 2
    while t := _longest(count, t):
        if count[t] >= 2 or len(np.flatnonzero(count[t + 1 : rest - t + 1])):
            break
        t -= 1
    return (j, a, b) if b and t <= b else None


def best_fit(count: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Best fit, longest pieces first; count is emptied."""
    by_room: dict[int, list[list]] = {}  # room left -> groups [n, pieces]
    done: list[Group] = []
    for s in range(capacity, 0, -1):
        n = int(count[s])
        count[s] = 0
        for room in sorted(r for r in by_room if r >= s):
            if not n:
                break
            per, groups = room // s, by_room.pop(room)
            while groups:
                size, pieces = groups.pop()
                full = min(size, n // per)
                parts = [(full, per), (1, n - full * per)] if full < size and n - full * per else [(full, per)]
                for m, times in parts:
                    if m and times:
                        by_room.setdefault(room - times * s, []).append([m, (*pieces, (s, times))])
                        n -= m * times
                        size -= m
                if size:
                    by_room.setdefault(room, []).append([size, pieces])
                if not n:
                    break
            for g in groups:
                by_room.setdefault(room, []).append(g)
        per = capacity // s
        for m, times in ((n // per, per), (1, n % per)):
            if m and times:
                by_room.setdefault(capacity - times * s, []).append([m, ((s, times),)])
    for groups in by_room.values():
        done += [(n, pieces) for n, pieces in groups]
    return done


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    return reduce_instance(count, capacity) + best_fit(count, capacity)


def intervals(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, times per sequence, first sequence, offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for n, pieces in groups:
        offset = 0
        for length, times in pieces:
            start = used.get(length, 0)
            rows.append((length, start, times, sequence, offset))
            used[length] = start + n * times
            offset += length * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and their rank among pieces of that length."""
    row = np.zeros(len(length), np.int64)
    for s in np.unique(length):
        lo, hi = np.searchsorted(table[:, 0], [s, s + 1])
        some = length == s
        row[some] = lo + np.searchsorted(table[lo:hi, 1], rank[some], "right") - 1
    _, first, times, sequence, offset = table[row].T if len(row) else np.zeros((5, 0), np.int64)
    k = rank - first
    return sequence + k // np.maximum(times, 1), offset + k % np.maximum(times, 1) * length


def cut(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) part, local_rank among the task's pieces of that length."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]):
        pa.default_memory_pool().release_unused()  # what earlier stages' batches left in this worker
        words, part, seen = word_ids(path, remembered), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            row, piece, length, crc, rank, ids = [], [], [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                data = words.encode(t) + end
                for p in range(0, len(data), 4 * capacity):
                    x = data[p : p + 4 * capacity]
                    n = len(x) // 4
                    row.append(k)
                    piece.append(p // (4 * capacity))
                    length.append(n)
                    crc.append(zlib.crc32(x))
                    rank.append(seen[n])
                    seen[n] += 1
                    if keep_ids:
                        ids.append(x)
            piece = np.array(piece, np.int32)
            arrays = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * keep_ids, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long, part int, local_rank long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces with sequence_id and offset. A worker remembers the ids of so many words."""
    pieces = materialize(cut(docs, path, end_id, capacity, keep_ids, remembered), "pieces")
    per_task = pieces.groupBy("part", "length").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(per_task.select("part", "length", "count", before.alias("before")), "piece-ranks")
    counts = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most one row per length
    table = intervals(plan(counts, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = pieces.join(offsets.drop("count"), ["part", "length"]).select(*names, (F.col("before") + F.col("local_rank")).alias("rank"))

    def run(batches):
        for b in batches:
            sequence, offset = place(table, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")
