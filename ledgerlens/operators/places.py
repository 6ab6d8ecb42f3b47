"""Places in texts: parcel identifiers, streets, settlements, and the parcel or street a text is about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distance_km
from .grouping import components

_PARCEL_LIST = r"(?<!\d)(\d{5}\.\d{1,4}\.\d{1,5}(?!\d)(?:\.\d{1,4}(?!\d)|(?:\s*,\s*\d{1,5}(?!\d|\.\d))*))"
_MARKER = r"(?:(?<!\p{L})(?:булевард|улица)(?!\p{L})|(?<!\p{L})(?:бул|ул)\.)\s*"
_QUOTED = "|".join(f"{a}[^{b}]*{b}" for a, b in (("„", "“"), ("“", "“"), ('"', '"'), ("'", "'"), ("‘", "’"), ("«", "»")))
# What ends an unquoted street name.
_STOPS = r",|;|\)| в участък| от о\.т\.| между| до | гр\.| с\.| к\.к\.| и ул\."
_STREET = rf"(?i)({_MARKER}(?:{_QUOTED}|.+?(?={_STOPS}|$)))"
_TRIM = " \t\n\"'„“”’‘«»"


def parcel_ids(text: Column, settlements: Sequence[str]) -> Column:
    """Identifiers of known settlements in order of appearance: lists are expanded, a unit also names its parcel."""

    def expand(found: Column) -> Column:
        parts = F.transform(F.split(found, ","), lambda p: F.trim(p))
        head = F.element_at(parts, 1)
        prefix, parcel = F.regexp_extract(head, r"^(\d{5}\.\d{1,4}\.)", 1), F.regexp_extract(head, r"^(\d{5}\.\d{1,4}\.\d{1,5})", 1)
        return F.concat(F.array(head, parcel), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(prefix, p)))

    lists = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PARCEL_LIST), F.lit(1))
    own = F.filter(lists, lambda x: F.substring(x, 1, 5).isin(*settlements))
    return F.array_distinct(F.flatten(F.transform(own, expand)))


def lookup_keys(ids: Column) -> Column:
    """The parcels (first three parts) of identifiers."""
    return F.array_distinct(F.transform(ids, lambda i: F.regexp_extract(i, r"^(\d+\.\d+\.\d+)", 1)))


def settlements(text: Column, aliases: Sequence[tuple[str, str]], ekatte: dict[str, str] | None = None, municipal: str | None = None, before: Sequence[str] = ("община", "общ.")) -> Column:
    """Keys of the settlements that a text names, by first position: (key, alias) names as whole words in any case, dots and blanks optional, and parcels by their settlement code.

    The alias municipal doesn't count right after the words of before: there it names the municipality.
    """
    loose = lambda a: "".join(r"\.?\s*" if c == "." else r"\s*" if c.isspace() else c if c.isalnum() else "\\" + c for c in a)
    bare = lambda a: "".join(c for c in a.lower() if c != "." and not c.isspace())
    not_after = "".join(rf"(?<!{loose(w).replace('*', '{0,9}')}\s{{0,9}})" for w in before)
    names = [(not_after if a == municipal else "") + loose(a) for _, a in sorted(aliases, key=lambda x: (-len(x[1]), x))]
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join([*names, r'\d{5}(?=\.\d{1,4}\.\d{1,5})'])})(?![\p{{L}}\p{{N}}_])"
    known = {bare(a): k for k, a in reversed(list(aliases))} | (ekatte or {})
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(found, lambda x: F.try_element_at(lookup, F.regexp_replace(F.lower(x), r"[.\s]+", "")))))


def object_settlements(name: Column, *args, **kwargs) -> Column:
    """Settlements of a budget object's name: the one that stands alone after the last comma first, then by position."""
    found, tail = settlements(name, *args, **kwargs), settlements(F.when(F.contains(name, F.lit(",")), F.substring_index(name, ",", -1)), *args, **kwargs)
    return F.when(F.size(tail) == 1, F.array_distinct(F.concat(tail, found))).otherwise(found)


def referenced(parcels: DataFrame, ids: DataFrame, street_keys: DataFrame, street_types: Sequence[str]) -> DataFrame:
    """Parcels whose number is in ids (cadnum), and street parcels of a named street (ekatte, street_key)."""
    by_id = parcels.join(ids.select("cadnum").distinct(), "cadnum", "left_semi")
    keyed = parcels.where(F.col("usetype").isin(*street_types)).withColumn("street_key", street_key(F.col("street")))
    by_street = keyed.join(street_keys.select("ekatte", "street_key").distinct(), ["ekatte", "street_key"], "left_semi").select(*parcels.columns)
    return by_id.unionByName(by_street.join(ids.select("cadnum").distinct(), "cadnum", "left_anti").select(*parcels.columns))


def streets(text: Column) -> Column:
    """Street names after their markers, in order; quoted names whole, others up to the first stop."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_STREET), F.lit(1))
    bare = F.transform(found, lambda s: F.btrim(F.regexp_replace(s, f"(?i)^{_MARKER}", ""), F.lit(_TRIM)))
    return F.filter(bare, lambda s: s != "")


def street_key(name: Column) -> Column:
    """Comparable form of a street name: without marker, case, blanks and punctuation."""
    bare = F.regexp_replace(F.trim(name), r"(?i)^\s*(?:(?:булевард|улица)(?!\p{L})|(?:бул|ул)\.?(?!\p{L}))\s*", "")
    return F.coalesce(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]", ""), F.lit(""))


def split_streets(parcels: DataFrame, gap_km: float = 1.0) -> DataFrame:
    """(ekatte, street_key) of names whose parcels fall into groups more than gap_km apart: several streets of one name.

    Parcels are compared with those of their own and the neighbouring grid cells only.
    """
    keys = ["ekatte", "street_key"]
    lat, lon = F.col("centroid_lat"), F.col("centroid_lon")
    points = parcels.where(lat.isNotNull() & lon.isNotNull()).select(*keys, "cadnum", "centroid_lat", "centroid_lon", F.xxhash64("cadnum").alias("node"))
    step = gap_km / 111.2
    cells = points.withColumn("x", F.floor(lat / step)).withColumn("y", F.floor(lon * F.cos(F.radians(lat)) / step))
    around = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-2, -1, 0, 1, 2)])
    near = cells.select(*keys, F.explode(around).alias("c"), F.col("node").alias("other"), lat.alias("lat2"), lon.alias("lon2")).select(*keys, "c.x", "c.y", "other", "lat2", "lon2")
    edges = cells.join(near, [*keys, "x", "y"]).where((F.col("node") < F.col("other")) & (distance_km(lat, lon, F.col("lat2"), F.col("lon2")) <= gap_km))
    labels = components(edges.select(F.col("node").alias("a"), F.col("other").alias("b")))
    grouped = points.join(labels, "node", "left").groupBy(*keys).agg(F.countDistinct(F.coalesce("component", "node")).alias("n"))
    return grouped.where("n > 1").select(*keys)


def resolve(texts: DataFrame, candidates: DataFrame, parcels: DataFrame, settlements: Sequence[str]) -> DataFrame:
    """id, precision, place, lat, lon of texts (id, text) that name a known parcel, or a street of one settlement.

    candidates: (id, ekatte) settlements that a text may be about. Parcels come first. A street counts where
    exactly one candidate settlement has any of the named streets and the name isn't split; its point is the
    parcel nearest to the mean.
    """
    by_id = texts.select("id", F.posexplode(lookup_keys(parcel_ids(F.col("text"), settlements))).alias("pos", "cadnum"))
    hit = by_id.join(parcels.select("cadnum", "centroid_lat", "centroid_lon"), "cadnum")
    first = hit.groupBy("id").agg(F.min_by(F.struct("cadnum", "centroid_lat", "centroid_lon"), "pos").alias("p"))
    found = first.select("id", F.lit("parcel").alias("precision"), F.col("p.cadnum").alias("place"), F.col("p.centroid_lat").alias("lat"), F.col("p.centroid_lon").alias("lon"))

    named = texts.join(found, "id", "left_anti").select("id", F.posexplode(streets(F.col("text"))).alias("pos", "street")).withColumn("street_key", street_key(F.col("street"))).where("street_key <> ''")
    keyed = parcels.withColumn("street_key", street_key(F.col("street"))).where("street_key <> ''")
    known = keyed.select("ekatte", "street_key").distinct()
    matches = named.join(candidates, "id").join(known, ["ekatte", "street_key"])
    only = matches.groupBy("id").agg(F.countDistinct("ekatte").alias("n")).where("n = 1").select("id")
    whole = matches.join(only, "id", "left_semi").join(split_streets(keyed), ["ekatte", "street_key"], "left_anti")
    chosen = whole.groupBy("id").agg(F.min_by(F.struct("ekatte", "street_key", "street"), "pos").alias("s")).select("id", "s.*")
    points = keyed.where("centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL").select("ekatte", "street_key", "cadnum", "centroid_lat", "centroid_lon")
    w = Window.partitionBy("ekatte", "street_key")
    far = (F.col("centroid_lat") - F.avg("centroid_lat").over(w)) ** 2 + (F.col("centroid_lon") - F.avg("centroid_lon").over(w)) ** 2
    middle = points.withColumn("d", far).groupBy("ekatte", "street_key").agg(F.min_by(F.struct("centroid_lat", "centroid_lon"), F.struct("d", "cadnum")).alias("p"))
    by_street = chosen.join(middle, ["ekatte", "street_key"]).select("id", F.lit("street").alias("precision"), F.col("street").alias("place"), F.col("p.centroid_lat").alias("lat"), F.col("p.centroid_lon").alias("lon"))
    return found.unionByName(by_street)


def ring_centroid(ring: Column) -> Column:
    """struct<lon, lat, area> of a closed ring (array of structs lon, lat), weighted by area."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))
    cross = lambda p: p["a"]["lon"] * p["b"]["lat"] - p["b"]["lon"] * p["a"]["lat"]
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    area = total(cross) / 2
    lon = total(lambda p: (p["a"]["lon"] + p["b"]["lon"]) * cross(p)) / (6 * area)
    lat = total(lambda p: (p["a"]["lat"] + p["b"]["lat"]) * cross(p)) / (6 * area)
    return F.when((n >= 4) & (area != 0), F.struct(lon.alias("lon"), lat.alias("lat"), F.abs(area).alias("area")))
