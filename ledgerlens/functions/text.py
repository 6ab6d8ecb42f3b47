"""Text expressions: tokens, similarity, names, identifiers, markup, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning for matching, named places, the forms of parcel identifiers and streets.
STOP_WORDS = tuple(
    """
    за на в от до и или по към при с със да не се като през тази този тези то ще е са бр
    план плана планa проект проектиране изграждане основен ремонт текущ аварийно укрепване
    реконструкция преустройство устройство устройството строеж строителство
    на територията територия община общината общ гр град града с кв ул уpи упи м обект обекти
    района район находящ представляващ разположен участък участъка част нов нова нови
    сграда сградата сгради територия терена имот имота
    достав доставка доставки услуга услуги монтаж демонтаж баланс избор изпълнител нуждите
    нужди обособена обособени позиция позиции дейност дейности предмет брой броя вид видове
    смр оп етап етапа
    """.split()
)
PLACE_NAMES = ("свети", "влас", "равда", "обзор", "оризаре", "гюльовца", "кошарица", "баня", "тънково", "слънчев", "бряг", "русалка", "черно", "море", "раковсково", "паницово", "приселци")
PARCEL = r"\d+(?:[.,]\d+){2,}"
STREET = r"(?:^|[^\p{L}\p{N}_])(?:ул\.|улица)\s*[\"„]?\s*([a-zа-я]+)"
_NO_WORD = r"[^a-zа-я]+"


def _literals(words) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(words)))


_NOTHING = "array<string>"


def _where(test: Column, found: Column) -> Column:
    """found, looked for only in texts that pass a cheap test."""
    return F.when(test, found).otherwise(F.array().cast(_NOTHING))


def _parcels(low: Column) -> Column:
    return _where(low.rlike(r"\d[.,]\d"), _parcel_marks(low))


def _parcel_marks(low: Column) -> Column:
    return F.transform(F.regexp_extract_all(low, F.lit(f"({PARCEL})"), F.lit(1)), lambda p: F.concat(F.lit("CAD:"), p))


def tokens(text: Column, stop_words=STOP_WORDS, min_length: int = 3) -> Column:
    """Distinct lower-case words of at least min_length letters without stop words, and parcel identifiers as CAD:…"""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(F.when(low.rlike(r"\d[.,]\d"), F.regexp_replace(low, PARCEL, " ")).otherwise(low), _NO_WORD), lambda w: F.length(w) >= min_length)
    return F.array_distinct(F.concat(F.array_except(words, _literals(stop_words)), _parcels(low)))


def distinctive(text: Column, places=PLACE_NAMES, stop_words=STOP_WORDS) -> Column:
    """Tokens that identify an object alone: parcels as CAD:…, places, streets as ST:…"""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.array_intersect(F.split(low, _NO_WORD), _literals(places))
    streets = _where(low.contains("ул"), F.array_except(F.regexp_extract_all(low, F.lit(STREET), F.lit(1)), _literals(stop_words)))
    return F.array_distinct(F.concat(_parcels(low), named, F.transform(streets, lambda s: F.concat(F.lit("ST:"), s))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union that two sets have in common; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def name_key(name: Column) -> Column:
    """Comparable form of a person's or company's name."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def canonical_ids(text: Column, width: int = 9) -> Column:
    """Digit-only identifiers of a delimited list, left-padded to width (never cut), in order, without repeats."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda p: F.trim(p))
    digits = F.filter(parts, lambda p: p.rlike(r"^[0-9]+$"))
    return F.array_distinct(F.transform(digits, lambda p: F.when(F.length(p) < width, F.lpad(p, width, "0")).otherwise(p)))


_REFERENCE = r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def unescape(text: Column) -> Column:
    """text with its character references resolved in one pass: all named ones of HTML, decimal and hexadecimal ones; unknown ones stay."""
    import json
    from html.entities import html5

    known = {k[:-1]: v for k, v in html5.items() if k.endswith(";")} | {"nbsp": " "}
    named = F.from_json(F.lit(json.dumps(known)), "map<string,string>")  # one literal, folded once: plans stay small

    def resolved(part: Column) -> Column:
        name = F.regexp_extract(part, _REFERENCE, 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        code = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        found = F.when(code.isNull(), F.try_element_at(named, name)).when(valid, char).otherwise("\ufffd")
        return F.when(name == "", F.concat(F.lit("&"), part)).otherwise(F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), part)))

    parts = F.split(text, "&", -1)
    whole = F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(resolved(p))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def strip_html(html: Column) -> Column:
    """Text of flat markup: tags become blanks, character references are resolved, white space is collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]*>", " ")), r"[ \t\n\r]+", " "))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def slug(name: Column) -> Column:
    """ASCII path segment of at most 80 characters; a short digest where nothing ASCII is left."""
    ascii_ = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(ascii_ != "", F.substring(ascii_, 1, 80)).otherwise(F.substring(F.sha1(name), 1, 12))


def digits_before_unit(text: Column) -> Column:
    """Whether a number stands before a unit of measure, or two numbers are multiplied."""
    unit = r"(?:бр|броя|броеве|кг|т|тона|л|литра|м|м2|м3|кв\.?\s?м|куб\.?\s?м|км|дка|ха|pcs|kg|tons?|km|m2|m3|liters?)"
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(rf"[0-9][0-9 .,]*(?:\p{{L}}+ )?{unit}(?:[^\p{{L}}]|$)") | low.rlike(r"[0-9]+ ?[xх×*] ?[0-9]+")


def parse_number(text: Column) -> Column:
    """Double of a number with blanks as thousands separators and a decimal comma; null where it isn't one."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s ]+", ""), ",", ".").try_cast("double")


def basename(path: Column) -> Column:
    """File name at the end of a path or url, decoded."""
    return F.url_decode(F.regexp_extract(path, r"([^/?#]+)(?:[?#].*)?$", 1))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance."""
    per_degree = 111.2
    x = (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + (lat1 - lat2) * (lat1 - lat2)) * per_degree
