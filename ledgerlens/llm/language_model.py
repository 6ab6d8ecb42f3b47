"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, scored from memory-mapped hash arrays.

Vocabulary. Words are hashed on the text's bytes (64 bits) and counted; a word's id is its place in the order
of falling powers of two of its count, so frequent words have small ids. One number per shard and power of two
reaches the driver, and no word does.

Counting, from the highest order down. A task counts its n-grams of ids and sends them, sorted and compressed,
to shards. An n-gram's shard follows from its context, or from all its words where every word of the context
is among the frequent ones (more than 1 / FREQUENT of all tokens each, so at most FREQUENT words): a context is
whole in its shard unless it is too frequent to be. A shard adds up its n-grams, writes their hashes, sorted,
and their counts into its file of the model, and sends on what the next lower order needs: for every context
the tokens and the types seen once, twice and more often, for every n-gram without its first word the number
of words before it. There are at most SHARDS shards; on larger inputs a shard is worked off and stored in
ranges of the hash of about SHARD_INPUT bytes of input each, which arrive sorted, so no task grows with the
input. N-grams that begin a text are counted as often as they occur at the lower orders too, since nothing
precedes them.

Scoring. A worker maps the shards' files into memory, one map per order and shard, looks up a few million
tokens at a time in sorted order (so that pages are read forward), and sums log10 probabilities per document.
The folder has to be a file system that all workers mount: spark.checkpoint.dir with scheme file, or
``folder``. Counting is exact; a lookup of an unseen n-gram meets another's count with a probability of about
2 in 10^9, at any size of the model (32 bits behind an index of about eight hashes an entry).

Cases: null and empty texts have one token, their end. A null doc_id counts as the text ''. Repeated rows
are counted and scored like any other. Without training tokens every probability is uniform over one unseen
word. Extra columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, shuffle_partitions

ORDER = 3
SLICE = 2 << 20  # bytes of text hashed at a time
TOKENS = 2 << 20  # tokens counted at a time in a task
SHARDS = 8192  # at most
SHARD_INPUT = 32 << 20  # input bytes per shard, or per range of a shard
FREQUENT = 4096

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
END = np.uint64(0x8D3C5A1B7F2E9046)
BLOB = "shard int, span int, blob binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_of(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams given as columns of ids."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h *= np.uint64(0xA24BAED4963EE407)
        h += c
        h += np.uint64(1)
        h = _mix(h)
    return h


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable argsort of 64-bit keys. Sorting numbers is several times faster than sorting their places, so the leading bits are sorted with the place in the last ones; keys that these leave in disorder are few, and sorted then."""
    if not len(keys):
        return np.empty(0, np.int64)
    width = np.uint64(len(keys).bit_length())
    free = np.uint64(64 - int(keys.max()).bit_length())
    leading = keys << free >> width << width
    leading |= np.arange(len(keys), dtype=np.uint64)
    leading.sort()
    order = (leading & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    if free < width:
        s = keys[order]
        if (s[1:] < s[:-1]).any():
            order = order[np.argsort(s, kind="stable")]
    return order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted; the place of every key among them)."""
    order = _order(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    at = np.empty(len(s), np.int64)
    at[order] = np.cumsum(new) - 1
    return s[new], at


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash: sorted hashes have sorted parts."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Words:
    """Hashes of the words of many texts at once."""

    def __init__(self):
        self.power, self.inverse = _powers(_BASE, 1024), _powers(_INVERSE, 1024)
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token hashes with an end after every text, tokens of each text)."""
        data = self.lower[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        if len(self.power) < len(data):
            self.power, self.inverse = (_powers(b, len(data) + len(data) // 8) for b in (_BASE, _INVERSE))
        blank = self.blank[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.power[: len(data)]
        np.cumsum(terms, out=total[1:])
        word = _mix((total[ends] - total[starts]) * self.inverse[starts])
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        upto = np.searchsorted(starts, text_ends)
        out = np.empty(len(word) + len(texts), np.uint64)
        last = upto + np.arange(len(texts))
        keep = np.ones(len(out), bool)
        keep[last] = False
        out[keep], out[last] = word, END
        return out, np.diff(last, prepend=-1)


def _slices(batches: Iterator[pa.RecordBatch], names: list[str], at_once: int) -> Iterator[tuple[list[list], list[bytes]]]:
    """Columns names and the texts as bytes, about at_once bytes at a time."""
    cols, texts, size = [[] for _ in names], [], 0
    for b in batches:
        values = [b.column(n).to_pylist() for n in names]
        for k, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            for c, v in zip(cols, values, strict=True):
                c.append(v[k])
            texts.append(t or b"")
            size += len(texts[-1]) + 1
            if size >= at_once:
                yield cols, texts
                cols, texts, size = [[] for _ in names], [], 0
    if texts:
        yield cols, texts


def local_folder(uri: str) -> str:
    """The path of a mounted folder; model arrays are mapped into memory and need one."""
    scheme, sep, rest = uri.partition(":")
    if sep and "/" not in scheme and scheme != "file":
        raise ValueError(f"the model folder has to be mounted on all workers (scheme file), not {uri}")
    path = rest if sep and scheme == "file" else uri
    return "/" + path.lstrip("/")


def _save(folder: str, name: str, segments: list[dict[str, np.ndarray]]) -> None:
    """Arrays of all ranges in one file with an index at its end; written beside and renamed, so that a repeated task leaves one whole file."""
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    index = []
    with open(beside, "wb") as f:
        for s in segments:
            at = {}
            for k, a in s.items():
                f.write(b"\0" * (-f.tell() % 8))
                at[k] = (a.dtype.str, f.tell(), len(a))
                f.write(np.ascontiguousarray(a).tobytes())
            index.append(at)
        tail = json.dumps(index).encode()
        f.write(tail + len(tail).to_bytes(8, "little"))
    os.replace(beside, f"{folder}/{name}")


def _open(path: str) -> list[dict[str, np.ndarray]]:
    """The arrays of a file, mapped."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(data[-8:], "little")
    return [{k: np.frombuffer(data, t, size, at) for k, (t, at, size) in s.items()} for s in json.loads(data[-8 - n : -8])]


def _indexed(h: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes as 32 bits each behind an index of their leading bits, about eight hashes to an entry."""
    lead = max(0, len(h).bit_length() - 4)
    starts = np.searchsorted(h >> np.uint64(64 - lead) if lead else np.zeros(len(h), np.uint64), np.arange((1 << lead) + 1))
    return {"starts": _smallest(starts), "tails": (h >> np.uint64(32 - lead)).astype(np.uint32)}


def _places(segment: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of hashes among the stored ones."""
    starts, tails = segment["starts"], segment["tails"]
    lead = len(starts).bit_length() - 1 if len(starts) > 2 else 0
    entry = (h >> np.uint64(64 - lead) if lead else np.zeros(len(h), np.uint64)).astype(np.int64)
    tail = (h >> np.uint64(32 - lead)).astype(np.uint32)
    at, end = starts[entry].astype(np.int64), starts[entry + 1].astype(np.int64)
    last = len(tails) - 1
    wide = end - at
    for k in range(int(wide.max(initial=0)).bit_length() - 1, -1, -1):
        step = 1 << k
        if k > 3:  # few entries are so long
            rows = np.flatnonzero(wide >= step)
            probe = at[rows] + step
            less = (probe <= end[rows]) & (tails[np.minimum(probe - 1, last)] < tail[rows])
            at[rows] += less * step
        else:
            probe = at + (step - 1)
            less = probe < end
            np.minimum(probe, last, out=probe)
            less &= tails[probe] < tail
            at += less.view(np.int8) << np.int8(k)
    hit = at < end
    np.minimum(at, last, out=at)
    hit &= tails[at] == tail
    return at, hit


def _narrow(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in one byte each; those of 255 and more stand in a list of places and values."""
    big = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), name + "-at": big.astype(np.uint32 if len(values) < 1 << 32 else np.uint64), name + "-value": values[big].astype(np.uint64)}


def _wide(segment: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    small = segment[name][at]
    out, big = small.astype(np.int64), np.flatnonzero(small == 255)
    if len(big):
        out[big] = segment[name + "-value"][np.searchsorted(segment[name + "-at"], at[big])]
    return out


def _pack(columns: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """Sorted rows of ids and numbers, compressed byte plane by byte plane; the first column by differences."""
    from zstandard import ZstdCompressor

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0)) if columns else None
    planes = []
    for a in [*([first, *columns[1:]] if columns else []), *numbers]:
        planes.extend((a >> a.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(a.itemsize))
    kinds = json.dumps([[a.dtype.str for a in columns], [a.dtype.str for a in numbers], len((columns or numbers)[0])]).encode()
    return len(kinds).to_bytes(4, "little") + kinds + ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    from zstandard import ZstdDecompressor

    k = 4 + int.from_bytes(blob[:4], "little")
    of_columns, of_numbers, n = json.loads(blob[4:k])
    data, at, out = ZstdDecompressor().decompress(blob[k:]), 0, []
    for t in [*of_columns, *of_numbers]:
        width = np.dtype(t).itemsize
        whole = np.frombuffer(data, np.uint8, n, at).astype(t)
        for k in range(1, width):
            whole |= np.frombuffer(data, np.uint8, n, at + k * n).astype(t) << np.dtype(t).type(8 * k)
        out.append(whole)
        at += n * width
    columns = out[: len(of_columns)]
    if columns:
        columns[0] = np.cumsum(columns[0], dtype=columns[0].dtype)
    return columns, out[len(of_columns) :]


def _smallest(values: np.ndarray) -> np.ndarray:
    """values in the narrowest unsigned type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _bits(columns: list[np.ndarray]) -> list[int]:
    return [max(1, int(c.max(initial=0)).bit_length()) for c in columns]


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, sorted; every value's rank), by a table where that isn't much longer than the values."""
    s = np.sort(values)
    own = s[np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))]
    if int(own[-1]) >= 8 * len(values) + (1 << 20):
        return own, np.searchsorted(own, values)
    table = np.empty(int(own[-1]) + 1, np.uint32)
    table[own] = np.arange(len(own), dtype=np.uint32)
    return own, table[values]


def _added_up(columns: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of columns, sorted, and the sums of their numbers.

    Columns are laid into one 64-bit key, as ranks where they are too wide. A lone column of numbers, mostly ones, is
    added up by the lengths of the runs of the sorted keys and what its other values have beyond one.
    """
    if not len(columns[0]):
        return columns, numbers
    given, values = columns, [None] * len(columns)
    if sum(_bits(columns)) > 64:
        values, columns = map(list, zip(*map(_ranks, columns), strict=True))
    bits = _bits(columns)
    if sum(bits) > 64:
        order = np.lexsort(given[::-1])
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in given:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        return [c[order[first]] for c in given], [np.add.reduceat(v[order], first) for v in numbers]
    key = columns[0].astype(np.uint64)
    for c, n in zip(columns[1:], bits[1:], strict=True):
        key <<= np.uint64(n)
        key |= c.astype(np.uint64, copy=False)
    alone = len(numbers) == 1
    order = None if alone else _order(key)
    s = np.sort(key) if alone else key[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    s = s[first]
    if alone:
        sums = np.diff(first, append=len(key))
        other = np.flatnonzero(numbers[0] != 1)
        np.add.at(sums, np.searchsorted(s, key[other]), numbers[0][other] - 1)
        added = [sums]
    else:
        added = [np.add.reduceat(v[order], first) for v in numbers]
    out: list[np.ndarray] = []
    for v, n, c in zip(values[::-1], bits[::-1], given[::-1], strict=True):
        own = s & np.uint64((1 << n) - 1)
        out.insert(0, own.astype(c.dtype) if v is None else v[own.astype(np.int64)])
        s = s >> np.uint64(n) if n < 64 else s
    return out, added


def _joined(blobs: list[bytes], n: int, m: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All rows of n columns and m numbers."""
    parts = [_unpack(b) for b in blobs]
    columns = [np.concatenate([c[k] for c, _ in parts] or [np.empty(0, np.uint32)]) for k in range(n)]
    return columns, [np.concatenate([v[k] for _, v in parts] or [np.empty(0)]).astype(np.int64) for k in range(m)]


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(shard, range, blobs), one range after the other; they arrive sorted."""
    place, held = None, []
    for b in batches:
        for shard, span, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "span", "blob")), strict=True):
            if (shard, span) != place and held:
                yield *place, held
                held = []
            place = shard, span
            held.append(blob)
    if held:
        yield *place, held


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, span, blob = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(span, pa.int32()), pa.array(blob, pa.binary())], ["shard", "span", "blob"])


@dataclass(frozen=True)
class Layout:
    """How n-grams are dealt to shards and ranges."""

    shards: int
    spans: int
    words: int = 0  # distinct training tokens; this number is also the id of what precedes a text, and the next one that of unseen words
    frequent: int = 0  # ids below it are frequent words

    def place(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(shard * spans + span, hash) of n-grams."""
        h = hash_of(columns)
        by = h
        if len(columns) > 1:
            often = np.ones(len(h), bool)
            for c in columns[:-1]:
                often &= (c < self.frequent) | (c == self.words)
            by = np.where(often, h, hash_of(columns[:-1]))
        return part_of(by, self.shards) * self.spans + part_of(_mix(h), self.spans), h

    def send(self, columns: list[np.ndarray], numbers: list[np.ndarray]) -> pa.RecordBatch:
        """Rows, sorted or nearly so, as one blob for each shard and range."""
        place, _ = self.place(columns)
        order = np.argsort(place.astype(np.uint16) if self.shards * self.spans <= 1 << 16 else place, kind="stable")
        columns, numbers, place = [c[order] for c in columns], [v[order] for v in numbers], place[order]
        cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place)).tolist()
        return _rows([(int(place[a]) // self.spans, int(place[a]) % self.spans, _pack([c[a:b] for c in columns], [_smallest(v[a:b]) for v in numbers])) for a, b in zip(cuts, cuts[1:], strict=False)])


def _dealt(rows: DataFrame, layout: Layout) -> DataFrame:
    return rows.repartitionById(layout.shards, "shard").sortWithinPartitions("shard", "span")


#: What an n-gram below the highest order holds: words before it; as a context: tokens, and types seen once, twice, more often.
NUMBERS = ("count", "tokens", "once", "twice", "more")


def windows(ids: np.ndarray, sizes: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """Columns of the n-grams that end at every token; start stands before a text."""
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [ids]
    for k in range(1, order):
        c = np.full(len(ids), start, ids.dtype)
        c[k:] = ids[:-k]
        c[at < k] = start
        out.insert(0, c)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts; half of each count where they are undefined."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))


@dataclass
class LanguageModel:
    folder: str
    layout: Layout
    order: int
    tokens: int  # training tokens
    discounts: list[tuple[float, float, float]]  # by order
    base_tokens: int  # sum of the lowest order's counts
    base_rest: float  # mass that the lowest order leaves to the uniform distribution, times base_tokens
    have: dict[str, frozenset[int]]  # shards that have a file
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def _segments(self, name: str) -> list[dict[str, np.ndarray]]:
        if name not in self._maps:
            self._maps[name] = _open(f"{self.folder}/{name}")
        return self._maps[name]

    def _find(self, kind: str, place: np.ndarray, keys: np.ndarray, spans: int, values: tuple[str, ...]) -> list[np.ndarray]:
        """The values of keys at their places; zero where a key is absent. Ids are one more than stored."""
        found = [np.zeros(len(keys), np.int64) for _ in values]
        width = np.uint64(max(1, (self.layout.shards * spans).bit_length()))
        order = _order(place.astype(np.uint64) << (np.uint64(64) - width) | keys >> width)
        place, keys = place[order], keys[order]
        cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place)).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            shard, span = divmod(int(place[lo]), spans)
            if shard not in self.have[kind]:
                continue
            segment = self._segments(f"{kind}-{shard}")[span]
            if not len(segment["tails"]):
                continue
            at, hit = _places(segment, keys[lo:hi])
            for f, v in zip(found, values, strict=True):
                f[lo:hi] = segment["ids"][at].astype(np.int64) + 1 if v == "ids" else _wide(segment, v, at)
                f[lo:hi] *= hit
        out = [np.empty(len(keys), np.int64) for _ in values]
        for o, f in zip(out, found, strict=True):
            o[order] = f
        return out

    def ids(self, words: np.ndarray, with_counts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, training counts, every word's place in them) of the distinct hashed words; unseen words have count 0 and the id after the last."""
        every, at = _distinct(words)
        found = self._find("words", part_of(every, self.layout.shards), every, 1, ("ids", "count") if with_counts else ("ids",))
        ids = np.where(found[0] > 0, found[0] - 1, self.layout.words + 1).astype(np.uint32 if self.layout.words < (1 << 32) - 2 else np.uint64)
        return ids, found[-1], at

    def _numbers(self, columns: list[np.ndarray], names: tuple[str, ...]) -> list[np.ndarray]:
        place, h = self.layout.place(columns)
        return self._find(f"grams{len(columns)}", place, h, self.layout.spans, names)

    def log_probabilities(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 of the add-one unigram base, known) of every token of whole texts."""
        own_ids, own_counts, at = self.ids(words)
        ids, count = own_ids[at], own_counts[at]
        base = np.log10((own_counts + 1) / (self.tokens + self.layout.words + 1))[at]
        columns = windows(ids, sizes, self.order, self.layout.words)
        starts = np.cumsum(sizes) - sizes
        p = np.full(len(ids), 1 / (self.layout.words + 1))
        context: list[np.ndarray] = []
        for n in range(1, self.order + 1):
            names = NUMBERS if n < self.order else NUMBERS[:1]
            c, *own = [v[at] for v in self._numbers([own_ids], names)] if n == 1 else self._numbers(columns[self.order - n :], names)
            left = np.maximum(c - _discount(c, self.discounts[n - 1]), 0)
            if n == 1:
                p = (left + self.base_rest * p) / self.base_tokens if self.base_tokens else p
            else:
                tokens, once, twice, more = context
                d1, d2, d3 = self.discounts[n - 1]
                p = np.where(tokens > 0, (left + (d1 * once + d2 * twice + d3 * more) * p) / np.maximum(tokens, 1), p)
            if n < self.order:  # a token's context is the n-gram that ends one token earlier, or what precedes a text
                first = self._numbers([np.full(1, self.layout.words, ids.dtype)] * n, NUMBERS[1:])
                context = [np.concatenate([f, v[:-1]]) for f, v in zip(first, own, strict=True)]
                for f, v in zip(first, context, strict=True):
                    v[starts] = f
        return np.log10(p), base, count > 0


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def _count_of_counts(counts: np.ndarray) -> list[int]:
    """Numbers of counts 1, 2, 3, 4; sum of all counts; number of counts above 2."""
    return [*np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist(), int(counts.sum()), int((counts > 2).sum())]


def held_out(doc_id: Column | str) -> Column:
    """True for the documents that the model doesn't learn from."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 7 == 2


def _tagged(rows: pa.RecordBatch, stats: list[int] | None) -> pa.RecordBatch:
    """Blobs for the next order and, in a row of its own, numbers for the driver."""
    parts = list(zip(*(rows.column(c).to_pylist() for c in ("shard", "span", "blob")), [None] * rows.num_rows, strict=True))
    if stats is not None:
        parts.append((None, None, None, stats))
    cols = list(zip(*parts, strict=True)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["shard", "span", "blob", "stats"])


TAGGED = BLOB + ", stats array<long>"


def _vocabulary(texts: DataFrame, folder: str, layout: Layout) -> tuple[Layout, int, frozenset[int]]:
    """Count words, write their hashes, ids and counts; (layout with words and frequent, training tokens, shards)."""
    one = Layout(layout.shards, 1)

    def count(batches):
        words, keys, counts, held, n = Words(), np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def merge():
            nonlocal keys, counts, held, n
            if held:
                k, c = np.unique(np.concatenate(held), return_counts=True)
                (keys,), (counts,) = _added_up([np.concatenate([keys, k])], [np.concatenate([counts, c])]) if len(keys) else ([k], [c])
                held, n = [], 0

        def send():
            place = part_of(keys, one.shards)
            cuts = np.searchsorted(place, np.arange(one.shards + 1)).tolist()
            return _rows([(s, 0, _pack([keys[a:b]], [_smallest(counts[a:b])])) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b])

        for _, t in _slices(batches, [], SLICE):
            held.append(words.hashes(t)[0])
            n += len(held[-1])
            if n >= TOKENS:
                merge()
                if len(keys) >= TOKENS:
                    yield send()
                    keys, counts = keys[:0], counts[:0]
        merge()
        if len(keys):
            yield send()

    def add_up(batches):
        for shard, _, blobs in _by_place(batches):
            (keys,), (counts,) = _added_up(*_joined(blobs, 1, 1))
            _save(folder, f"counts-{shard}", [{"keys": keys, "count": counts}])
            yield _tagged(_rows([]), [shard, int(counts.sum()), *np.bincount(_power(counts), minlength=64).tolist()])

    def number(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                (s,) = _open(f"{folder}/counts-{shards[k]}")
                power = _power(s["count"])
                order = np.argsort(power, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes[k]) - sizes[k], sizes[k])
                ids = place + first[k][power]
                _save(folder, f"words-{shards[k]}", [{**_indexed(s["keys"]), "ids": _smallest(ids), **_narrow("count", s["count"])}])
            yield pa.RecordBatch.from_arrays([b.column("id")], ["id"])

    counted = materialize(_dealt(texts.mapInArrow(count, BLOB), one).mapInArrow(add_up, TAGGED).select("stats"), "word-counts")
    rows = sorted(r.stats for r in counted.collect())  # one row per shard, at most SHARDS
    discard(counted)
    shards = [r[0] for r in rows]
    sizes = np.array([r[2:] for r in rows], np.int64).reshape(-1, 64)  # [shard, power], from the highest power down
    first = (np.cumsum(sizes.sum(0)) - sizes.sum(0))[None, :] + np.cumsum(sizes, 0) - sizes
    total = sum(r[1] for r in rows)
    enough = [k for k in range(64) if 1 << (63 - k) >= max(1, total // FREQUENT)]
    spark = texts.sparkSession
    if shards:
        spark.range(0, len(shards), 1, len(shards)).mapInArrow(number, "id long").write.format("noop").mode("overwrite").save()
    return Layout(layout.shards, layout.spans, int(sizes.sum()), int(sizes.sum(0)[enough].sum())), total, frozenset(shards)


def _power(counts: np.ndarray) -> np.ndarray:
    """0 for the highest power of two, 63 for one."""
    return 63 - (np.frexp(np.maximum(counts, 1).astype(float))[1] - 1).astype(np.int64)


def _lower(columns: list[np.ndarray], counts: np.ndarray, start: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What sorted n-grams and their counts tell of the next lower order: rows of ids with NUMBERS, those of contexts, then those of suffixes."""
    some = counts > 0  # all but contexts that nothing precedes
    if not some.all():
        columns, counts = [c[some] for c in columns], counts[some]
    if not len(counts):
        return columns[:-1], [counts] * len(NUMBERS)
    new = np.zeros(len(counts), bool)
    new[0] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)  # rows are sorted, so a context's are neighbours
    as_context = [np.add.reduceat(v, first, dtype=np.int64) for v in (counts, counts == 1, counts == 2, counts > 2)]
    suffixes, (before,) = _added_up(columns[1:], [np.where(columns[1] == start, counts, 1)])
    lower = [np.concatenate((c[first], x)) for c, x in zip(columns[:-1], suffixes, strict=True)]
    none = np.zeros(len(before), np.int64)
    return lower, [np.concatenate((np.zeros(len(first), np.int64), before)), *(np.concatenate((v, none)) for v in as_context)]


def fit(docs: DataFrame, train: Column, folder: str | None = None, order: int = ORDER) -> LanguageModel:
    """Count the texts of docs for which train holds; the arrays go to folder, or to the shared work folder."""
    spark = docs.sparkSession
    folder = local_folder(folder or new_path(spark, "language-model"))
    os.makedirs(folder, exist_ok=True)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= 1 << 60 else size  # Spark's word for unknown
    shards = min(SHARDS, max(shuffle_partitions(spark), -(-size // SHARD_INPUT)))
    texts = docs.where(train).select("text")
    layout, tokens, have = _vocabulary(texts, folder, Layout(shards, max(1, -(-size // (SHARD_INPUT * shards)))))
    words = LanguageModel(folder, layout, order, tokens, [], 0, 0.0, {"words": have})

    def count(batches):
        hashes, held, n = Words(), [], 0

        def send():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return layout.send(*_added_up(columns, [np.ones(len(columns[0]), np.int64)]))

        for _, t in _slices(batches, [], SLICE):
            h, sizes = hashes.hashes(t)
            ids, _, at = words.ids(h, False)
            held.append(windows(ids[at], sizes, order, layout.words))
            n += len(h)
            if n >= TOKENS:
                yield send()
                held, n = [], 0
        if n:
            yield send()

    def add_up(n: int):
        names = NUMBERS[:1] if n == order else NUMBERS

        def run(batches):
            none = _indexed(np.empty(0, np.uint64)) | {k: v for name in names for k, v in _narrow(name, np.empty(0, np.int64)).items()}
            for shard, ranges in groupby(_by_place(batches), lambda x: x[0]):
                segments, stats = [none] * layout.spans, np.zeros(6, np.int64)
                for _, span, blobs in ranges:
                    columns, numbers = _added_up(*_joined(blobs, n, len(names)))
                    h = hash_of(columns)
                    by_hash = _order(h)
                    segments[span] = _indexed(h[by_hash])
                    for name, v in zip(names, numbers, strict=True):
                        segments[span] |= _narrow(name, v[by_hash])
                    stats += _count_of_counts(numbers[0])
                    if n > 1:
                        yield _tagged(layout.send(*_lower(columns, numbers[0], layout.words)), None)
                _save(folder, f"grams{n}-{shard}", segments)
                yield _tagged(_rows([]), [*stats.tolist(), shard])

        return run

    sent, written, seen, files = texts.mapInArrow(count, BLOB), None, {}, {"words": have}
    for n in range(order, 0, -1):
        before, written = written, materialize(_dealt(sent, layout).mapInArrow(add_up(n), TAGGED), f"grams{n}")
        if before is not None:
            discard(before)
        stats = [r.stats for r in written.where("stats IS NOT NULL").select("stats").collect()]  # one row per shard, at most SHARDS
        seen[n] = np.sum([x[:6] for x in stats] or [[0] * 6], axis=0).tolist()
        files[f"grams{n}"] = frozenset(x[6] for x in stats)
        sent = written.where("blob IS NOT NULL").select("shard", "span", "blob")
    discard(written)
    by_order = [discounts(*seen[n][:4]) for n in range(1, order + 1)]
    d, (n1, n2, _, _, base, more) = by_order[0], seen[1]
    return LanguageModel(folder, layout, order, tokens, by_order, base, d[0] * n1 + d[1] * n2 + d[2] * more, files)


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score, score."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = Words()
        for cols, texts in _slices(batches, ["doc_id", "held_out"], SLICE):
            hashes, sizes = words.hashes(texts)
            p, base, known = model.log_probabilities(hashes, sizes)
            first = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch_type), pa.array(cols[1], pa.bool_()), pa.array(sizes.astype(np.int64)), pa.array(total(known.astype(np.int64))), pa.array(np.full(len(texts), model.tokens, np.int64)), pa.array(total(base)), pa.array(total(p))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Fit on the documents that aren't held out, score all."""
    marked = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return score(marked, fit(marked, ~F.col("held_out"), order=order))
