"""Companies, debts and contracts that officials declare, from the text of their declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sections import entries

# Wordings of the declaration form's headings, its relations, legal forms, quotes, and what we write for relations.
COMPANY_HEADING = "участие в търговски дружества"
DEBT_HEADINGS = ("задължения над 5000", "задължения над 5 000", "задължение над 5000", "задължение над 5 000")
CONTRACT_HEADING = ("договори с лица", "извършват дейност")
PART = "част "
RELATIONS = ("едноличен собственик", "съдружник", "акционер", "управител", "член на управителен орган", "член на контролен орган", "едноличен търговец")
SHARE, DEBT, CONTRACT = "участие в търговско дружество", "задължение над 5 000 лв.", "договор с лице, свързано с вземаните решения"
LEGAL_FORMS = ("ЕООД", "ООД", "ЕАД", "АД", "КД", "ДЗЗД", "ЕТ")
QUOTES = (("„", "“"), ("“", "”"), ('"', '"'), ("'", "'"))
INTEREST = "struct<company_name: string, eik: string, relation: string, raw: string>"


def heading(line: Column) -> Column:
    """company, debt or contract; '' at another part of the form; null at a line that is no heading."""
    low = F.lower(F.regexp_replace(line, r"\s+", " "))
    one, two = CONTRACT_HEADING
    first = F.locate(one, low)
    after = F.substring(low, first + len(one), F.lit(60 + len(two)))
    debt = F.lit(False)
    for words in DEBT_HEADINGS:
        debt = debt | low.contains(words)
    return F.when(low.contains(COMPANY_HEADING), "company").when(debt, "debt").when((first > 0) & after.contains(two), "contract").when(low.startswith(PART), "")


def eik_of(line: Column) -> Column:
    """The first number of nine or thirteen digits that stands alone."""
    found = F.regexp_extract(line, r"(?<![\p{L}\p{N}_])([0-9]{13}|[0-9]{9})(?![\p{L}\p{N}_])", 1)
    return F.when(found != "", found)


def quoted(line: Column) -> Column:
    """What stands in the line's first pair of quotes, by kind of quote; null without one."""
    ways = []
    for a, b in QUOTES:
        start = F.locate(a, line)
        end = F.locate(b, F.substring(line, start + 1, F.length(line)))
        ways.append(F.when((start > 0) & (end > 0), F.trim(F.substring(line, start + 1, end - 1))))
    return F.coalesce(*ways)


def company_name(line: Column) -> Column:
    """A quoted name with the legal form that follows it; else what stands before the number, without bullets; else the line."""
    name = quoted(line)
    tail = F.ltrim(F.substring(line, F.instr(line, name) + F.length(name), F.lit(12)), F.lit("„“”\"' "))
    form = F.upper(F.regexp_extract(tail, rf"(?iu)^({'|'.join(LEGAL_FORMS)})(?!\p{{L}})", 1))
    word = F.regexp_instr(line, F.lit(r"(?iu)(?<!\p{L})еик(?!\p{L})"))
    number = F.coalesce(F.instr(line, eik_of(line)), F.lit(0))
    cut = F.when(word > 0, word).when(number > 0, number).otherwise(F.length(line) + 1)
    bare = F.btrim(F.regexp_replace(F.substring(line, F.lit(1), cut - 1), r"^[\d.)\-–•\s]+", ""), F.lit(" ,-–"))
    return F.when(name.isNotNull(), F.concat_ws(" ", name, F.when(form != "", form))).when(bare != "", bare).otherwise(line)


def interest(section: Column, line: Column) -> Column:
    """The interest that a line of a section declares; null without a solid sign of one: a number or a relation, an amount, a number or a name."""
    low, eik = F.lower(line), eik_of(line)
    relations = F.filter(F.array(*map(F.lit, RELATIONS)), lambda r: low.contains(r))
    stated = F.array_join(relations, "; ")
    amount = low.rlike("лв|eur|€")
    relation = (
        F.when((section == "company") & (stated != ""), stated)
        .when((section == "company") & eik.isNotNull(), SHARE)
        .when((section == "debt") & amount, DEBT)
        .when((section == "contract") & (eik.isNotNull() | quoted(line).isNotNull()), CONTRACT)
    )
    made = F.struct(company_name(line).alias("company_name"), eik.alias("eik"), relation.alias("relation"), line.alias("raw"))
    return F.when(relation.isNotNull(), made)


def declared_interests(declarations: DataFrame) -> DataFrame:
    """id, pos, section, company_name, eik, relation, raw of the interests in declarations (id, text)."""
    found = entries(F.col("text"), heading, interest, INTEREST)
    return declarations.select("id", F.explode(found).alias("e")).select("id", "e.pos", "e.section", "e.entry.*")


def interests(text: Column) -> Column:
    """The same as the array that officials carry."""
    return F.transform(entries(text, heading, interest, INTEREST), lambda e: e["entry"])
