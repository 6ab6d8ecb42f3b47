"""A finite-state transducer over the lines of a text, as one expression: headings set the state, lines give entries in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries(text: Column, heading: Callable[[Column], Column], extract: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<struct<pos, section, entry>> of a text's lines, in order.

    heading(line) names the section that starts at a line, '' where only the present one ends, and null at other
    lines. extract(section, line) gives an entry of the type kind, or null. Lines are trimmed; blank lines and lines
    before any heading give nothing. The state is a struct (section, line number, entries so far).
    """
    item = f"struct<pos: int, section: string, entry: {kind}>"
    start = F.struct(F.lit("").alias("section"), F.lit(0).alias("pos"), F.array().cast(f"array<{item}>").alias("out"))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda line: F.btrim(line, F.lit(" \t \u000b\f")))

    def step(state: Column, line: Column) -> Column:
        named = heading(line)
        found = F.when(named.isNull() & (state["section"] != "") & (line != ""), extract(state["section"], line))
        made = F.struct(state["pos"].alias("pos"), state["section"].alias("section"), found.alias("entry"))
        out = F.when(found.isNotNull(), F.concat(state["out"], F.array(made.cast(item)))).otherwise(state["out"])
        return F.struct(F.coalesce(named, state["section"]).alias("section"), (state["pos"] + 1).alias("pos"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda state: state["out"])
