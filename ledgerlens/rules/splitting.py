"""Contracts that together reach a boundary that each of them stays below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import text as X
from ..operators import grouping as G
from ..operators.amounts import money
from . import provenance as V
from .common import cited, findings
from .contracts import bands, with_regime
from .registry import RULES


def units(view: DataFrame, by_contractor: bool) -> DataFrame:
    """One unit per tender (and contractor): summed value, first day, attributes of the first row."""
    rows = with_regime(view.where("source = 'eop' AND signed AND tender IS NOT NULL"))
    keys = ["tender", "contractor"] if by_contractor else ["tender"]
    first = F.min_by(F.struct("level", "category", "cpv_code", "contractor", "id", X.tokens(F.col("title")).alias("tokens"), X.distinctive(F.col("title")).alias("marks")), "id").alias("f")
    out = rows.groupBy(*keys).agg(F.sum(money("eur")).cast("double").alias("value"), F.min("signed_on").alias("on"), first, F.sort_array(F.collect_list("subject")).alias("subjects"))
    flat = out.select("value", F.datediff("on", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), "f.level", "f.category", "f.cpv_code", F.col("f.contractor").alias("contractor"), F.col("f.id").alias("unit_id"), "f.tokens", F.filter("f.marks", _one_object).alias("objects"), "subjects")
    return flat.where("category IS NOT NULL AND day IS NOT NULL AND level IS NOT NULL")


def _groups(rows: DataFrame, key: str, category: str, t: Thresholds, similar) -> DataFrame:
    limits = [(round(b, 6), level) for c, b, level in bands(t) if c == category]
    return G.rolling_groups(rows.where(F.col("category") == category), key, "unit_id", "day", "value", bands=limits, level="level", days=t.splitting_days, min_members=t.splitting_min, renewal_gap=t.splitting_gap_days, similar=similar)


def _one_object(mark: Column) -> Column:
    """Parcels and streets tell one building site from another; a place doesn't."""
    return mark.startswith("CAD:") | mark.startswith("ST:")


def _same_division(a, b) -> bool:
    return str(a.cpv_code or "")[:2] == str(b.cpv_code or "")[:2]


def _same_place(a, b) -> bool:
    return bool(set(a.objects) & set(b.objects))


def _alike(a, b) -> bool:
    x, y = set(a.tokens), set(b.tokens)
    return bool(x and y) and len(x & y) / len(x | y) >= 0.5


def _alike_place(a, b) -> bool:
    return _alike(a, b) and _same_place(a, b)


def split_groups(view: DataFrame, t: Thresholds) -> DataFrame:
    """Groups of one contractor, and groups of one CPV class that no contractor's group contains."""
    one, two = units(view, True), units(view, False).withColumn("cpv5", F.substring("cpv_code", 1, 5))
    parts = []
    for path, rows, key in ((1, one, "contractor"), (2, two, "cpv5")):
        for category in ("works", "supplies", "annex2"):
            similar = {(1, "works"): _same_place, (2, "works"): _alike_place, 1: _same_division, 2: _alike}
            g = _groups(rows, key, category, t, similar.get((path, category), similar[path]))
            parts.append(g.withColumn("path", F.lit(path)))
    groups = parts[0]
    for p in parts[1:]:
        groups = groups.unionByName(p)
    ids = two.select("unit_id", "subjects").unionByName(one.select("unit_id", "subjects"))
    subjects = groups.select("group_key", "anchor_id", "boundary", "path", F.explode("member_ids").alias("unit_id"))
    per_path = ids.groupBy("unit_id").agg(F.array_distinct(F.flatten(F.collect_list("subjects"))).alias("subjects"))
    members = subjects.join(per_path, "unit_id").groupBy("group_key", "anchor_id", "boundary", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("subjects")))).alias("members"))
    full = groups.join(members, ["group_key", "anchor_id", "boundary", "path"])
    a, b = full.where("path = 1").alias("a"), full.where("path = 2").alias("b")
    covered = b.join(a.select(F.col("members").alias("outer_members"), F.explode("members").alias("m")), F.col("m") == F.element_at("b.members", 1)).where(F.size(F.array_except("b.members", "outer_members")) == 0).select("b.group_key", "b.anchor_id", "b.boundary").distinct()
    return full.where("path = 1").unionByName(full.where("path = 2").join(covered, ["group_key", "anchor_id", "boundary"], "left_anti").select(*full.columns))


@RULES.table_rule("splitting", reads=("split_groups", "contracts"))
def splitting(groups: DataFrame, view: DataFrame, t: Thresholds) -> DataFrame:
    """split_groups as findings, with the contracts of their members as sources, by date and subject."""
    keys = ["group_key", "anchor_id", "boundary", "path"]
    members = groups.select(*keys, F.explode("members").alias("subject")).join(view, "subject")
    groups = groups.join(cited(members, keys, V.contract_sources((*V.MEMBER, "ProcedureType"), []), ["signed_on", "subject"]), keys, "left")
    level = F.when(F.col("total") > t.splitting_high_ratio * F.col("boundary"), "high").otherwise("warning")
    whole = F.floor("boundary").cast("string")
    key = F.concat_ws(":", F.lit("split"), F.col("group_key").cast("string"), whole, F.col("anchor_id").cast("string"))
    return findings(groups, "splitting", severity=level, message=F.concat(F.col("n").cast("string"), F.lit(" contracts together reach a boundary that each stays below")), subject_type="contract_group", subject_id=F.col("group_key"), key=key, details={"members": F.col("members"), "total": F.col("total"), "boundary": F.col("boundary")}, sources=F.col("cited"))


def split_subjects(groups: DataFrame) -> DataFrame:
    return groups.select(F.explode("members").alias("subject")).distinct()


