"""Keyed stores without in-place updates: finding lifecycle, tolerant upserts, partition replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("rule", "subject_key")


def first_emitted(findings: DataFrame, order: str, key: Sequence[str] = KEY) -> DataFrame:
    """The first finding of each key in emission order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return findings.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def merge_findings(stored: DataFrame, produced: DataFrame, ran: Sequence[str], now: Column, key: Sequence[str] = KEY) -> DataFrame:
    """The new store after a run of the rules ran.

    Both sides have the key and payload columns; stored also has first_seen_at, last_seen_at, resolved_at.
    A produced key is new or updated (and open again); a stored open key that its rule, which ran, no longer
    produces is resolved now; rules that didn't run are left alone. Column change says what happened.
    """
    payload = [c for c in produced.columns if c not in key]
    s, p = stored.alias("s"), produced.alias("p")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]
    hit, old = F.col("p.__new").isNotNull(), F.col("s.__old").isNotNull()
    joined = s.withColumn("__old", F.lit(True)).alias("s").join(p.withColumn("__new", F.lit(True)).alias("p"), on, "full_outer")
    gone = old & ~hit & F.col("s.resolved_at").isNull() & F.col(f"s.{key[0]}").isin(list(ran))
    change = F.when(hit & ~old, "new").when(hit, "updated").when(gone, "resolved").otherwise("unchanged")
    return joined.select(
        *[F.coalesce(f"p.{k}", f"s.{k}").alias(k) for k in key],
        *[F.when(hit, F.col(f"p.{c}")).otherwise(F.col(f"s.{c}") if c in stored.columns else F.lit(None)).alias(c) for c in payload],
        F.when(old, F.col("s.first_seen_at")).otherwise(now).alias("first_seen_at"),
        F.when(hit, now).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
        F.when(hit, F.lit(None)).when(gone, now).otherwise(F.col("s.resolved_at")).alias("resolved_at"),
        change.alias("change"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], cents: Sequence[str] = ()) -> DataFrame:
    """stored with incoming laid over it by NULL-safe keys; column change is inserted, updated or same.

    Only non-null incoming fields overwrite. Columns in cents count as changed from one cent on.
    """
    fields = [c for c in stored.columns if c not in key]
    s, i = stored.withColumn("__old", F.lit(True)).alias("s"), incoming.withColumn("__new", F.lit(True)).alias("i")
    joined = s.join(i, [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key], "full_outer")
    old, new = F.col("s.__old").isNotNull(), F.col("i.__new").isNotNull()
    differs = F.lit(False)
    for c in fields:
        if c in incoming.columns:
            a, b = F.col(f"s.{c}"), F.col(f"i.{c}")
            same = F.round(a.cast("decimal(18,4)"), 2).eqNullSafe(F.round(b.cast("decimal(18,4)"), 2)) if c in cents else a.eqNullSafe(b)
            differs = differs | (b.isNotNull() & ~same)
    keys = [F.when(old, F.col(f"s.{k}")).otherwise(F.col(f"i.{k}")).alias(k) for k in key]
    values = [F.coalesce(f"i.{c}", f"s.{c}").alias(c) if c in incoming.columns else F.col(f"s.{c}").alias(c) for c in fields]
    return joined.select(*keys, *values, F.when(~old, "inserted").when(new & differs, "updated").otherwise("same").alias("change"))


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in incoming are replaced as a whole; others stay."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def survivors(rows: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """What NOT IN leaves behind: rows whose key is valid, and rows without a key."""
    return rows.join(valid.select(key).distinct(), key, "left_semi").unionByName(rows.where(F.col(key).isNull()))


def upsert_officials(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored (name, short_name, role, mandate, name_source_url, ...) with incoming laid over it.

    A record is the same where, within role and mandate, the full names are equal or the short ones are (a
    missing short name is the full one). A full name that was resolved is never replaced by a short one.
    """
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    others = [c for c in incoming.columns if c not in ("name", "short_name", "role", "mandate", "name_source_url")]

    def side(rows: DataFrame) -> DataFrame:
        short = F.coalesce("short_name", "name")
        return rows.withColumn("short_name", short).withColumn("__full", key(F.col("name"))).withColumn("__short", key(short))

    s, i = side(stored).withColumn("__sid", F.struct("role", "mandate", "__full")), side(incoming)
    on = lambda c: (F.col("s.role").eqNullSafe(F.col("i.role"))) & (F.col("s.mandate").eqNullSafe(F.col("i.mandate"))) & (F.col(f"s.{c}") == F.col(f"i.{c}"))
    pairs = [s.alias("s").join(i.alias("i"), on(c)).select(F.col("s.__sid").alias("sid"), F.struct("i.*").alias("i"), F.lit(k).alias("k")) for k, c in enumerate(("__full", "__short"))]
    best = pairs[0].unionByName(pairs[1]).groupBy("sid").agg(F.min_by("i", "k").alias("i"))
    hits = best.select("i.*").alias("h")
    same = F.col("n.role").eqNullSafe(F.col("h.role")) & F.col("n.mandate").eqNullSafe(F.col("h.mandate")) & (F.col("n.__full") == F.col("h.__full"))
    new = i.alias("n").join(hits, same, "left_anti")
    met = s.join(best, s["__sid"] == best["sid"], "left")
    hit, resolved, enriched = F.col("i").isNotNull(), F.col("i.__full") != F.col("i.__short"), F.col("__full") != F.col("__short")
    rename = hit & (resolved | ~enriched)
    kept = met.select(
        F.when(rename, F.col("i.name")).otherwise(F.col("name")).alias("name"),
        F.when(hit, F.col("i.short_name")).otherwise(F.col("short_name")).alias("short_name"),
        "role",
        "mandate",
        F.when(hit & resolved, F.col("i.name_source_url")).otherwise(F.col("name_source_url")).alias("name_source_url"),
        *[F.when(hit, F.col(f"i.{c}")).otherwise(F.col(c)).alias(c) for c in others],
    )
    url = F.when(F.col("__full") != F.col("__short"), F.col("name_source_url")).alias("name_source_url")
    return kept.unionByName(new.select("name", "short_name", "role", "mandate", url, *others))


def upsert_reports(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored (url, period, kind, period_source, kind_source, heading_period, file_path, fetched_at) with incoming (url, period, kind, file_path, fetched_at).

    A period or kind that was read from the file's content (source 'content') survives; the period that the
    site gives then goes to heading_period.
    """
    s, i = stored.withColumn("__old", F.lit(True)).alias("s"), incoming.withColumn("__new", F.lit(True)).alias("i")
    old, given = F.col("s.__old").isNotNull(), F.col("i.__new").isNotNull()
    locked = {c: F.coalesce(F.col(f"s.{c}_source") == "content", F.lit(False)) for c in ("period", "kind")}
    field = lambda c: F.when(old & locked[c], F.col(f"s.{c}")).otherwise(F.coalesce(f"i.{c}", f"s.{c}")).alias(c)
    fresh = lambda c: F.coalesce(f"i.{c}", f"s.{c}").alias(c)
    heading = F.when(old & given & locked["period"] & F.col("i.period").isNotNull(), F.col("i.period")).otherwise(F.col("s.heading_period")).alias("heading_period")
    return s.join(i, F.col("s.url") == F.col("i.url"), "full_outer").select(F.coalesce("s.url", "i.url").alias("url"), field("period"), field("kind"), "s.period_source", "s.kind_source", heading, fresh("file_path"), fresh("fetched_at"))
