"""Grouped messages: the gravest findings of each group in full, the rest as counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as D

# Marks and names of severities, and the wording around them.
EMOJI = {"high": "\U0001f6a8", "warning": "⚠️", "info": "ℹ️"}
NAMES = {"high": "сериозно", "warning": "предупреждение", "info": "информация"}
NOTHING, MORE = "Няма нови сигнали за уведомяване.", "...и още "
SHOWN = 10


def escaped(text: Column) -> Column:
    """Text that is safe inside markup."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _of(values: dict[str, str], key: Column, other: str | Column) -> Column:
    out = other if isinstance(other, Column) else F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def grouped_message(flags: DataFrame, groups: Sequence[str], *, flag_id: str, message: str, severity: str, order: Sequence[Column | str], base_url: str, title: str = "Нови сигнали", shown: int = SHOWN) -> DataFrame:
    """groups, n and text: one message for each group of flags; order has to be unique within a severity.

    The gravest come first, in the given order among equals; shown of them stand in full with a link, and the rest is
    counted by severity. Only the rows shown are gathered: each task first keeps its own best of every group, and
    counts are partial sums.
    """
    rank = F.coalesce(_of({k: str(n) for n, k in enumerate(D.SEVERITIES)}, F.col(severity), "9").cast("int"), F.lit(9))
    w = Window.partitionBy(*groups).orderBy(rank, *order)
    best = flags.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= shown)
    link = F.concat(F.lit(f"{base_url}/flags/#"), F.col(flag_id).cast("string"))
    line = F.concat(_of(EMOJI, F.col(severity), "•"), F.lit(" "), escaped(F.col(message)), F.lit('\n<a href="'), link, F.lit('">'), link, F.lit("</a>\n"))
    lines = best.groupBy(*groups).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"),
        *(F.count(F.when(F.col(severity).eqNullSafe(k), 1)).alias(f"__shown_{k}") for k in D.SEVERITIES),
    )
    counts = flags.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col(severity).eqNullSafe(k), 1)).alias(f"__all_{k}") for k in D.SEVERITIES))
    both = counts.join(lines, [counts[g].eqNullSafe(lines[g]) for g in groups]) if groups else counts.join(lines)
    left = {k: F.col(f"__all_{k}") - F.col(f"__shown_{k}") for k in D.SEVERITIES}
    part = lambda k: F.when(left[k] > 0, F.concat(F.lit(EMOJI[k] + " "), left[k].cast("string"), F.lit(" " + NAMES[k])))
    rest = F.concat_ws(", ", *(part(k) for k in sorted(D.SEVERITIES)))
    tail = F.when(F.col("n") > shown, F.concat(F.lit("\n" + MORE), (F.col("n") - shown).cast("string"), F.when(rest != "", F.concat(F.lit(": "), rest)).otherwise(""), F.lit("."))).otherwise("")
    head = F.concat(F.lit(f"<b>{title} — "), F.col("n").cast("string"), F.lit(" нов(и) сигнал(и)</b>\n\n"))
    text = F.when(F.col("n") == 0, NOTHING).otherwise(F.rtrim(F.concat(head, F.col("lines"), tail), F.lit("\n ")))
    return both.select(*(counts[g] for g in groups), "n", text.alias("text"))
