"""Groups of records that only together cross a boundary, and people behind several entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .amounts import money
from .components import stars
from .periods import episodes
from .sorted_groups import by_group

#: (key, anchor id, boundary, members, total, first and last day) of an accepted group.
GROUP_SCHEMA = "group_key {key}, anchor_id long, boundary double, n long, total double, first_day long, last_day long, member_ids array<long>"


def rolling_groups(rows: DataFrame, key: str, row_id: str, day: str, amount: str, *, bands: Sequence[tuple[float, int]], level: str | None = None, days: int = 365, min_members: int = 2, renewal_gap: int = 300, similar: Callable | None = None) -> DataFrame:
    """Greedy groups of one key: within days of an anchor, each member below the boundary, together at or above it.

    Bands are (boundary, level) from high to low; a row takes part below a boundary if its own level (0
    without a level column) is lower. Anchors are taken in (day, id) order; members are the anchor and the
    unused rows that ``similar(anchor, row)`` accepts. A group whose consecutive gaps are all renewal_gap or
    more is a renewal and not a split. Accepted rows are used up, across bands too. The choice is sequential
    within a key and independent between keys, and between gaps longer than days in a key, at which it is dealt into
    episodes. Rows without a day or an amount take no part. A task holds its largest episode as arrays; rows become
    objects only where ``similar`` asks for them, and only in episodes that can reach a boundary.
    """
    lowest = min(b for b, _ in bands)

    def groups(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        at, ids, value = (table.column(c).to_numpy() for c in (day, row_id, amount))
        cents = np.rint(value * 100).astype(np.int64)
        needed = table.column(level).to_numpy() if level else np.zeros(len(at))
        # a group that is too small in number or together stays below every boundary can't give any
        worth = np.flatnonzero((np.diff(starts) >= min_members) & (np.add.reduceat(cents, starts[:-1]) >= round(lowest * 100) - 1))
        used, out = np.zeros(len(at), bool), []
        for first, last in zip(starts[worth].tolist(), starts[worth + 1].tolist(), strict=True):
            here = slice(first, last)
            records = [SimpleNamespace(**r) for r in table.slice(first, last - first).to_pylist()] if similar else ()
            for boundary, required in sorted(bands, reverse=True):
                eligible = (value[here] < boundary) & (needed[here] < required)
                anchors = np.flatnonzero(eligible)
                ends = np.searchsorted(at[here], at[here][anchors] + days + 1)
                for k, end in zip(anchors.tolist(), ends.tolist(), strict=True):
                    if used[first + k]:
                        continue
                    begin = int(np.searchsorted(at[here], at[first + k]))
                    window = begin + np.flatnonzero(eligible[begin:end] & ~used[first + begin : first + end])
                    if similar is not None:
                        window = np.array([m for m in window.tolist() if m == k or similar(records[k], records[m])], np.int64)
                    total = round(int(cents[first + window].sum()) / 100, 2)
                    if len(window) < min_members or total < boundary or bool((np.diff(at[first + window]) >= renewal_gap).all()):
                        continue
                    used[first + window] = True
                    members = first + window
                    out.append((first + k, float(boundary), len(members), total, int(at[members[0]]), int(at[members[-1]]), ids[members].tolist()))
        columns = list(zip(*out, strict=True)) or [()] * 7
        anchor = pa.array(columns[0], pa.int64())
        kinds = (pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        made = [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)]
        keys = [table.column(c).take(anchor).combine_chunks() for c in (key, row_id)]
        return pa.RecordBatch.from_arrays([*keys, *made], ["group_key", "anchor_id", "boundary", "n", "total", "first_day", "last_day", "member_ids"])

    cols = [key, row_id, day, amount] + ([level] if level else [])
    schema = GROUP_SCHEMA.format(key=rows.schema[key].dataType.simpleString())
    typed = rows.where(F.col(day).isNotNull() & F.col(amount).isNotNull()).withColumns({row_id: F.col(row_id).cast("long"), day: F.col(day).cast("long"), amount: F.col(amount).cast("double")})
    dealt = episodes(typed if similar else typed.select(*dict.fromkeys(cols)), key, day, days)
    return by_group(dealt, [key, "episode"], groups, schema, order=(day, row_id))


def overlapping(groups: DataFrame, ids: DataFrame, id_name: str) -> DataFrame:
    """Rows of ids that are members of any group."""
    members = groups.select(F.explode("member_ids").alias(id_name)).distinct()
    return ids.join(members, id_name, "left_semi")


def concentration(links: DataFrame, person: str, entity: str, count: str, total: str, *, min_entities: int = 2, min_count: int = 3, min_total: float = 200_000, high_count: int = 6, high_total: float = 500_000) -> DataFrame:
    """People behind min_entities entities or more whose counts or totals together reach a bound."""
    per_entity = links.groupBy(person, entity).agg(F.max(count).alias("c"), F.max(total).alias("t"))
    grouped = per_entity.groupBy(person).agg(F.count(F.lit(1)).alias("n_entities"), F.sum("c").alias("n"), F.sum(money("t")).cast("double").alias("total"))
    kept = grouped.where((F.col("n_entities") >= min_entities) & ((F.col("n") >= min_count) | (F.col("total") >= min_total)))
    return kept.withColumn("severity", F.when((F.col("n") >= high_count) | (F.col("total") >= high_total), "high").otherwise("warning"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): smallest node reachable, over chains of any length."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    linked = stars(edges.select("a", "b")).withColumnRenamed("root", "component")
    return ends.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
