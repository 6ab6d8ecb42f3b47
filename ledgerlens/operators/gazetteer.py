"""Settlements in texts by an automaton over any number of names: ``places.settlements`` for large lists."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PARCEL = re.compile(r"\d{5}(?=\.\d{1,4}\.\d{1,5})(?!\w)")
#: Characters of all names at most; the list goes to every worker once.
MOST = 64_000_000


def _bare(name: str) -> str:
    return "".join(c for c in name.lower() if c != "." and not c.isspace())


def _loose(name: str) -> str:
    return "".join(r"\.?\s*" if c == "." else r"\s*" if c.isspace() else re.escape(c) for c in name)


class Gazetteer:
    """Finds names as ``places.settlements`` does: whole words in any case, dots and blanks of a name optional, the longest name first where several start, and no two that overlap.

    An Aho-Corasick automaton runs over a text without dots and blanks; what it finds is held against the name's own
    form at its place. Its size and a text's time don't depend on how the names are written in a plan.
    """

    def __init__(self, aliases: Sequence[tuple[str, str]], ekatte: dict[str, str] | None = None, municipal: str | None = None, before: Sequence[str] = ("община", "общ.")):
        import ahocorasick

        self.known = {_bare(a): k for k, a in reversed(list(aliases))} | (ekatte or {})
        self.municipal = municipal
        self.after_municipal = [re.compile(rf"(?:{_loose(w)})\s{{0,9}}\Z", re.I) for w in before]
        self.names = [a for _, a in sorted(aliases, key=lambda x: (-len(x[1]), x)) if _bare(a)]
        self.forms: list[re.Pattern | None] = [None] * len(self.names)
        self.automaton = ahocorasick.Automaton()
        by_bare: dict[str, list[int]] = {}
        for k, name in enumerate(self.names):
            by_bare.setdefault(_bare(name), []).append(k)
        for bare, ks in by_bare.items():
            self.automaton.add_word(bare, (len(bare), ks))
        if by_bare:
            self.automaton.make_automaton()

    def _match(self, k: int, text: str, start: int) -> int | None:
        """Where name k ends if it stands at start."""
        if self.forms[k] is None:
            self.forms[k] = re.compile(_loose(self.names[k]) + r"(?!\w)", re.I)
        if self.names[k] == self.municipal and any(p.search(text[max(0, start - 80) : start]) for p in self.after_municipal):
            return None
        m = self.forms[k].match(text, start)
        return m and m.end()

    def find(self, text: str | None) -> list[str]:
        text = text or ""
        places = [i for i, c in enumerate(text) if c != "." and not c.isspace()]
        squeezed = "".join(c if len(c := text[i].lower()) == 1 else text[i] for i in places)
        at: dict[int, list[int]] = {}
        if len(self.automaton):
            for end, (n, ks) in self.automaton.iter(squeezed):
                at.setdefault(places[end - n + 1], []).extend(ks)
        for m in PARCEL.finditer(text):
            at.setdefault(m.start(), [])
        found: dict[str, None] = {}
        past = 0
        for start in sorted(at):
            if start < past or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                continue
            for k in sorted(at[start]):
                if end := self._match(k, text, start):
                    break
            else:
                m = PARCEL.match(text, start)
                if not m:
                    continue
                end = m.end()
            past = end
            key = self.known.get(_bare(text[start:end]))
            if key is not None:
                found[key] = None
        return list(found)


_MADE: dict[int, Gazetteer] = {}


def settlements_of_many(text: Column | str, aliases: Iterable[tuple[str, str]], ekatte: dict[str, str] | None = None, municipal: str | None = None, before: Sequence[str] = ("община", "общ.")) -> Column:
    """``places.settlements`` for lists of thousands of (key, alias): one Arrow function, whose automaton each worker builds once."""
    from pyspark.sql import SparkSession

    names = list(aliases)
    if sum(len(a) for _, a in names) > MOST:
        raise ValueError(f"names of over {MOST} characters don't go to every worker")
    given = SparkSession.getActiveSession().sparkContext.broadcast((names, ekatte, municipal, tuple(before)))
    number = hash((tuple(names), municipal, tuple(before), tuple(sorted((ekatte or {}).items()))))

    def run(texts: pa.Array) -> pa.Array:
        if number not in _MADE:
            _MADE.clear()
            _MADE[number] = Gazetteer(*given.value)
        find = _MADE[number].find
        return pa.array([find(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)
