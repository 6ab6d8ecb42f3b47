"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

The transducer reads one byte at a time. Its state is the bytes of the current pretoken that no token covers
yet; a step appends a byte and emits the tokens that have become stable, so every id of every text leaves
through ``Transducer.step``. A token is stable once no continuation can change it, for either of two reasons:

- What is read so far ends in a boundary or inside one later token, which starts at a position j such that the
  bytes from j on begin some vocabulary entry. Before j the tokens are those of the bytes before j alone (no
  merge crosses a boundary). Tokens on which all such positions agree are stable.
- ``lookahead`` derives from the merge list alone how many bytes to the right of a token's end can still change
  that token. Whether merge q = (u, v) happens depends on v being formed and on v not being taken first by an
  earlier merge (v, w), whose own fate depends on w, and so on with ever earlier merges; one pass over the
  merges in rank order gives the longest such chain. A token that ends that far back is stable.

The second reason bounds the state to the lookahead and one token, whatever the length of a run. Steps are
compiled when first taken into a transition table of at most STATES states, emptied when full; it holds no
texts, words or pretokens, and results don't depend on its size.

Text is cut into pretokens as it streams in: character classes are checked against the tokenizer's own
pre-tokenizer, so they agree on every code point, and a run that is still open is fed on without waiting for
its end.

Cases: null and empty texts have no ids and decode to the empty text. Repeated rows, null doc_ids and equal
texts give a row each. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
Strings of special tokens in a text get the special tokens' ids, as in the library.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import string
import unicodedata
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 16  # characters fed at a time
STATES = 200_000  # compiled states at most
END = 0xFF  # ends a pretoken; no byte of UTF-8

def byte_chars() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Sufficient lookahead in bytes of merges (left, right, result), in rank order, given token lengths.

    taken[t]: how far beyond t's end the question reaches whether an earlier merge has taken t from the right.
    formed[t]: how far beyond t's end t's own formation reaches.
    """
    taken: dict[int, int] = {}
    formed: dict[int, int] = {}
    reach = lambda t: max(taken.get(t, 0), formed.get(t, 0))
    for left, right, result in merges:
        formed[result] = reach(right)
        taken[left] = max(taken.get(left, 0), length[right] + reach(right))
    return max([0, *taken.values(), *formed.values()])


class State(dict):
    """Transitions compiled so far: byte -> (emitted ids, next state).

    live: (j, boundaries before j as bits) of the positions j of the pending bytes at which a token may start
    that reaches beyond them; the last is their end. All follows from the pending bytes alone.
    """

    __slots__ = ("live", "machine", "pending")

    def __init__(self, machine: Transducer, pending: bytes, live: tuple[tuple[int, int], ...]):
        super().__init__()
        self.machine, self.pending, self.live = machine, pending, live

    def __missing__(self, byte: int) -> tuple[bytes, State]:
        out = self.machine.step(self, byte)
        self[byte] = out
        return out


class Transducer:
    """Bytes of pretokens in, each closed by END; stable token ids out."""

    def __init__(self, merges: list[tuple[int, int, int]], raw: dict[int, bytes], of_byte: list[int], states: int = STATES):
        formed = set(of_byte)
        for a, b, c in merges:
            if a not in formed or b not in formed:
                raise ValueError("the merge list uses a token before it is formed")
            formed.add(c)
        self.raw, self.of_byte, self.states = raw, of_byte, states
        self.ranks = {(a, b): (k, c) for k, (a, b, c) in reversed(list(enumerate(merges)))}
        self.lookahead = lookahead(merges, {i: len(x) for i, x in raw.items()})
        self.begins = {x[:k] for x in raw.values() for k in range(1, len(x))}
        self.root = State(self, b"", ((0, 0),))
        self.known = {b"": self.root}

    def step(self, state: State, byte: int) -> tuple[bytes, State]:
        """What leaves when byte follows the pending bytes of state, and the state after it."""
        if byte == END:
            return _pack(self.merge(state.pending)), self.root
        p = state.pending + bytes((byte,))
        ids = self.merge(p)
        ends, bounds = [], 0
        for t in ids:
            ends.append((ends[-1] if ends else 0) + len(self.raw[t]))
            bounds |= 1 << ends[-1]
        live = [(j, before) for j, before in state.live if p[j:] in self.begins]
        agreed = bounds
        for j, before in live:
            agreed &= before | 1 << j
        far = len(p) - self.lookahead
        n = sum(e <= far or bool(agreed >> e) for e in ends)  # tokens that are stable
        cut = ends[n - 1] if n else 0
        if (known := self.known.get(p[cut:])) is None:
            if len(self.known) >= self.states:
                for old in self.known.values():
                    old.clear()
                self.known = {b"": self.root}
            live = [(j - cut, before >> cut & ~1) for j, before in [*live, (len(p), bounds)] if j >= cut]
            known = self.known[p[cut:]] = State(self, p[cut:], tuple(live))
        return _pack(ids[:n]), known

    def merge(self, data: bytes) -> list[int]:
        """Tokens of data alone, by the merge list: always the earliest merge, leftmost first."""
        ranks, ids = self.ranks, [self.of_byte[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = at = None
            for i in range(len(ids) - 1):
                r = ranks.get((ids[i], ids[i + 1]))
                if r and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap."""
        ranks, n = self.ranks, len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = ranks[a, b][1], -1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if r := ranks.get((ids[i], ids[nxt[i]])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get((ids[prev[i]], ids[i]))):
                heapq.heappush(heap, (r[0], prev[i], ids[prev[i]], ids[i]))
        return [x for x in ids if x >= 0]


class BytePairStream:
    """feed() text piece by piece, then finish(); both return ids as little-endian 32-bit integers."""

    def __init__(self, path: str, classes: tuple[tuple[str, str], tuple[str, str]] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_chars().items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        raw = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if s not in self.specials}
        self.table = [raw.get(i, b"") for i in range(1 + max([*vocab.values(), *self.specials.values()]))]
        for s, i in self.specials.items():
            self.table[i] = s.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.machine = Transducer(merges, raw, [vocab[c] for _, c in sorted(byte_chars().items())])
        self._patterns(*(classes or char_classes(path)))
        self.hold = max([3, *(len(s) - 1 for s in self.specials)])
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self._reset()

    def _patterns(self, letters: tuple[str, str], numbers: tuple[str, str]) -> None:
        """Each class as (below, from) U+10000: the lower part is one bitmap, so most tests stay cheap."""
        blank = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        high = "\U00010000-\U0010ffff"
        one = {k: f"[{low}]+|(?=[{high}])[{more}]" for k, (low, more) in (("L", letters), ("N", numbers))}
        one["O"] = f"[^{blank}{letters[0]}{numbers[0]}{high}]+|(?=[{high}])[^{letters[1]}{numbers[1]}]"
        self.runs = {k: re.compile(f"(?:{c})*") for k, c in one.items()} | {"W": re.compile(f"(?:[{blank}]+(?![^{blank}]))?")}
        named = "|".join(f" ?(?P<{k}>(?:{c})+)" for k, c in one.items())
        self.named = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{named}|(?P<W>[{blank}]+(?![^{blank}])|[{blank}]+)")
        self.pieces = re.compile(re.sub(r"\(\?P<[A-Z]>", "(?:", self.named.pattern))

    def _reset(self) -> None:
        self.text, self.run, self.state = "", None, self.machine.root

    def _read(self, data: bytes) -> bytes:
        """Drive the transducer over data."""
        out, state = [], self.state
        for b in data:
            ids, state = state[b]
            if ids:
                out.append(ids)
        self.state = state
        return b"".join(out)

    def _closed(self, text: str) -> bytes:
        """Ids of text that starts and ends where pretokens do."""
        return self._read(b"".join([p.encode() + b"\xff" for p in self.pieces.findall(text)]))

    def _open(self, final: bool) -> bytes:
        """Consume what is decided of self.text."""
        out = []
        last = len(self.text) if final else len(self.text) - self.hold
        if self.run and last >= 0:
            end = self.runs[self.run].match(self.text).end()
            cut = min(end, last)
            out.append(self._read(self.text[:cut].encode()))
            if not (final or end <= last):
                self.text = self.text[cut:]
                return b"".join(out)
            out.append(self._read(b"\xff"))
            self.text, self.run, last = self.text[end:], None, last - end
        if final:
            out.append(self._closed(self.text))
            self.text = ""
            return b"".join(out)
        at = last  # a blank before a non-blank always starts a pretoken
        while at > 0 and (at := self.text.rfind(" ", 0, at)) > 0 and self.text[at + 1].isspace():
            pass
        if at > 0:
            out.append(self._closed(self.text[:at]))
            self.text = self.text[at:]
        elif len(self.text) > SLICE:  # none: pretoken by pretoken, the last one as an open run
            at = 0
            for m in self.named.finditer(self.text):
                if m.end() > last:
                    if m.lastgroup and m.start() < last:
                        out.append(self._read(self.text[at:last].encode()))
                        self.run, at = m.lastgroup, last
                    break
                out.append(self._read(m[0].encode() + b"\xff"))
                at = m.end()
            self.text = self.text[at:]
        return b"".join(out)

    def feed(self, text: str) -> bytes:
        self.text += text
        out = []
        while self.special and "<" in self.text and (m := self.special.search(self.text)):
            rest, self.text = self.text[m.end() :], self.text[: m.start()]
            out += [self._open(True), _pack([self.specials[m[0]]])]
            self.run, self.text = None, rest
        return b"".join([*out, self._open(False)])

    def finish(self) -> bytes:
        out = self._open(True)
        self._reset()
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([*(self.feed(text[i : i + SLICE]) for i in range(0, len(text), SLICE)), self.finish()])

    def decoder(self) -> ByteToText:
        return ByteToText(self.table)


class ByteToText:
    """ids in, text out, as soon as its bytes are complete; broken sequences become U+FFFD."""

    def __init__(self, table: list[bytes]):
        self.table, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


def _pack(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


@cache
def char_classes(path: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """Letters and numbers as the tokenizer's pre-tokenizer sees them, as regular expression classes below and from U+10000."""
    import regex
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    out = []
    for kind, base, ascii_ in (("L", "a", string.ascii_letters), ("N", "1", string.digits)):
        newer = regex.compile(rf"\p{{{kind}}}")
        some = (c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == kind or unicodedata.category(c) == "Cn" and newer.match(c))
        chars = [*ascii_, *_joined(pre, base, "".join(some))]
        out.append((_as_class([c for c in chars if c < "\U00010000"]), _as_class([c for c in chars if c >= "\U00010000"])))
    return out[0], out[1]


def _joined(pre, base: str, some: str) -> list[str]:
    """The characters that the pre-tokenizer keeps in one piece with base; it cuts into pieces of one class."""
    out: list[str] = []
    for _, (i, j) in pre.pre_tokenize_str(some):
        if pre.pre_tokenize_str(base + some[i:j])[0][1] == (0, j - i + 1):
            out += some[i:j]
    return out


def _as_class(chars: list[str]) -> str:
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


_STREAMS: dict[str, BytePairStream] = {}


def stream(path: str, classes: tuple[tuple[str, str], tuple[str, str]] | None = None) -> BytePairStream:
    """One per worker process."""
    if path not in _STREAMS:
        _STREAMS[path] = BytePairStream(path, classes)
    return _STREAMS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian 32-bit, in one binary) of every text; null texts count as empty."""
    classes = char_classes(path)

    def run(batches):
        s = stream(path, classes)
        for b in batches:
            ids = [s.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every ids binary; null ids count as none."""
    classes = char_classes(path)

    def run(batches):
        s = stream(path, classes)
        for b in batches:
            out = []
            for ids in b.column("ids").to_pylist():
                d, a = s.decoder(), np.frombuffer(ids or b"", "<u4")
                out.append("".join([*(d.feed(a[i : i + SLICE].tolist()) for i in range(0, len(a), SLICE)), d.finish()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text is encoded, then decoded from its ids alone.

    One worker does both, so that a task holds one set of tables.
    """
    doc_type, classes = docs.schema["doc_id"].dataType.simpleString(), char_classes(path)

    def run(batches):
        s = stream(path, classes)
        for b in batches:
            n, encoded, decoded = [], [], []
            for t in b.column("text"):
                ids = s.encode(t.as_py() or "")
                d, a, h = s.decoder(), np.frombuffer(ids, "<u4"), sha256()
                for i in range(0, len(a), SLICE):
                    h.update(d.feed(a[i : i + SLICE].tolist()).encode())
                h.update(d.finish().encode())
                n.append(len(a))
                encoded.append(sha256(ids).hexdigest())
                decoded.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
