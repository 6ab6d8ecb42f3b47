"""Where a finding's numbers come from: one entry per record, with the fields as its source states them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import text as X
from ..operators.dates import local_date, net_date
from ..schemas import SOURCE
from .common import filled, to_eur

FIELD = "struct<name: string, value: string, value_eur: double>"
#: Whether entries get nothing but their kind.
_BARE: ContextVar[bool] = ContextVar("_BARE", default=False)
AMOUNTS = ("estimated_total", "spent_prior", "plan_current", "spent_period")


def field(name: str, value: Column, value_eur: Column | None = None) -> Column:
    eur = F.lit(None) if value_eur is None else F.round(value_eur.cast("double"), 2)
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), eur.cast("double").alias("value_eur"))


@contextmanager
def kinds_only(only: bool = True) -> Iterator[None]:
    """Entries that are built inside state their kind alone, where only is true: for callers that ask for no more."""
    token = _BARE.set(only)
    try:
        yield
    finally:
        _BARE.reset(token)


def entry(kind: str, label: Column, *, url: Column | None = None, file: Column | None = None, sheet: Column | None = None, row: Column | None = None, period: Column | None = None, fields=(), note: Column | None = None) -> Column:
    """One source; fields without a value are left out."""
    if _BARE.get():
        label, url, file, sheet, row, period, note, fields = *[None] * 7, ()
    some = listed(*((x["value"].isNotNull(), x) for x in fields), of=FIELD) if fields else F.array()
    parts = (("kind", F.lit(kind)), ("label", label), ("url", url), ("file", file), ("sheet", sheet), ("row", row), ("period", period), ("fields", some), ("note", note))
    return F.struct(*[(F.lit(None) if c is None else c).alias(n) for n, c in parts]).cast(SOURCE)


def listed(*items: tuple[Column, Column], of: str) -> Column:
    """The array of those (condition, item) whose condition holds. Unlike F.filter and F.array_compact it is compiled, items included."""
    nothing = F.array().cast(f"array<{of}>")
    parts = [F.when(where, F.array(item)).otherwise(nothing) for where, item in items]
    return F.concat(*parts) if parts else nothing


def file_name(path: Column, url: Column) -> Column:
    """Name of the cached file, else the last part of its url."""
    return F.coalesce(F.when(filled(path), X.basename(path)), X.basename(url))


def report_label(kind: Column, period: Column) -> Column:
    return F.concat_ws(", ", F.coalesce(kind, F.lit("report")), F.when(period.isNotNull(), D.period(period)))


def budget_row(fields=AMOUNTS, report: str = "report", note: Column | None = None) -> Column:
    """A ledger line: its file, sheet and row; amounts in the file's own currency (leva computed back) and in euro."""
    bgn = F.upper("currency") == "BGN"
    amounts = [field(c, F.when(bgn, D.leva(F.col(c))).otherwise(F.round(F.col(c).cast("double"), 2)), F.col(c)) for c in fields]
    url, path = F.col(f"{report}.url"), F.col(f"{report}.file_path")
    period = F.coalesce("period", F.col(f"{report}.period"))
    return entry("budget_file", F.concat_ws(": ", report_label(F.lit("CAPITAL"), period), "object_name"), url=url, file=file_name(path, url), sheet=F.coalesce("source_sheet", "unit"), row=F.col("source_row"), period=period, fields=amounts, note=note)


def budget_file(kind: Column, period: Column, url: Column, path: Column, note: Column | None = None) -> Column:
    return entry("budget_file", report_label(kind, period), url=url, file=file_name(path, url), period=period, note=note)


def _day(c: Column) -> Column:
    return local_date(net_date(c)).cast("string")


def _currency(code: Column) -> Column:
    return F.when(code == 1, "EUR").when(code == 3, "BGN")


def _amount(name: str, record: Column, currency: str) -> Column:
    return field(name, record[name], to_eur(record[name], record[currency]))


def _chosen(fields: dict[str, Callable[[], Column]], names: Sequence[str] | None) -> list[Column]:
    return [fields[n]() for n in (fields if names is None else names)]


def _has_contract() -> Column:
    return F.col("raw.contract").isNotNull()


def _has_tender() -> Column:
    return F.col("raw.procedure").isNotNull() | F.col("raw.tender_detail").isNotNull()


def eop_contract(names: Sequence[str] | None = None, note: Column | None = None) -> Column:
    """The contract record of the first register with the named fields, or all; null where there is none."""
    k = F.col("raw.contract")
    fields = {
        "ContractNumber": lambda: field("ContractNumber", F.col("source_id")),
        "TenderNumber": lambda: field("TenderNumber", k["TenderNumber"]),
        "ContractValue": lambda: _amount("ContractValue", k, "Currency"),
        "Currency": lambda: field("Currency", _currency(k["Currency"])),
        "CurrentContractValue": lambda: _amount("CurrentContractValue", k, "CurrentContractCurrency"),
        "CurrentContractCurrency": lambda: field("CurrentContractCurrency", _currency(k["CurrentContractCurrency"])),
        "ContractDate": lambda: field("ContractDate", _day(k["ContractDate"])),
        "TedPublishDate": lambda: field("TedPublishDate", _day(k["TedPublishDate"])),
        "TypeOfContract": lambda: field("TypeOfContract", k["TypeOfContract"]),
        "ContractSubject": lambda: field("ContractSubject", k["ContractSubject"]),
        "SupplierName": lambda: field("SupplierName", F.col("contractor_name")),
        "RegisterNumberList": lambda: field("RegisterNumberList", F.col("contractor_eik")),
        "ProcedureType": lambda: field("ProcedureType", F.col("procedure_type")),
    }
    label = F.concat(F.lit("contract "), F.coalesce("source_id", F.lit("?")), F.coalesce(F.concat(F.lit(" of "), k["TenderNumber"]), F.lit("")))
    return F.when(_has_contract(), entry("eop_contract", label, url=F.col("url"), fields=_chosen(fields, names), note=note))


def eop_tender(names: Sequence[str] | None = None, note: Column | None = None) -> Column:
    """The procedure and its detail; the procedure's fields come first. Null where there is neither, or none of its fields is named."""
    p, d = F.col("raw.procedure"), F.col("raw.tender_detail")
    fields = {
        "SpecialNumber": lambda: field("SpecialNumber", p["SpecialNumber"]),
        "ProcedureType": lambda: field("ProcedureType", F.col("procedure_type")),
        "EstimatedValue": lambda: _amount("EstimatedValue", p, "Currency"),
        "Currency": lambda: field("Currency", _currency(p["Currency"])),
        "PublicationDate": lambda: field("PublicationDate", F.coalesce(_day(p["PublicationDate"]), _day(d["PublicationDate"]))),
        "OfferPhaseStartDate": lambda: field("OfferPhaseStartDate", _day(d["OfferPhaseStartDate"])),
        "OfferPhaseEndDate": lambda: field("OfferPhaseEndDate", F.coalesce(_day(p["OfferPhaseEndDate"]), _day(d["OfferPhaseEndDate"]))),
        "IsEUFinanced": lambda: field("IsEUFinanced", p["IsEUFinanced"]),
        "TenderName": lambda: field("TenderName", d["TenderName"]),
        "TenderDescription": lambda: field("TenderDescription", X.truncate(F.when(d["TenderDescription"].isNotNull(), F.try_element_at("descriptions", F.lit(1))), 300)),
    }
    number = F.coalesce(p["SpecialNumber"], F.col("raw.contract.TenderNumber"))
    return F.when(_has_tender(), entry("eop_tender", F.concat_ws(" ", F.lit("procedure"), number), url=F.col("url"), fields=_chosen(fields, names), note=note))


def sigma(names: Sequence[str] | None = None, note: Column | None = None) -> Column:
    """The second register's row."""
    s = F.col("raw.sigma")
    fields = {
        "id": lambda: field("id", F.col("source_id")),
        "unp": lambda: field("unp", s["unp"]),
        "subject": lambda: field("subject", F.col("title")),
        "contractor": lambda: field("contractor", F.col("contractor_name")),
        "contractor_eik": lambda: field("contractor_eik", F.col("contractor_eik")),
        "value_eur": lambda: field("value_eur", F.col("contract_value_eur"), F.col("contract_value_eur")),
        "signed_at": lambda: field("signed_at", local_date(F.col("contract_date")).cast("string")),
        "bids_received": lambda: field("bids_received", F.col("bids_received")),
        "procedure": lambda: field("procedure", s["procedure"]),
        "eu_funded": lambda: field("eu_funded", s["eu_funded"]),
    }
    return entry("sigma", F.concat(F.lit("row "), F.coalesce("source_id", F.lit("?"))), url=F.col("url"), fields=_chosen(fields, names), note=note)


def sigma_twin(twin: Column) -> Column:
    """The second register's row behind a contract of the first, from (source_id, unp, bids)."""
    fields = [field("id", twin["source_id"]), field("unp", twin["unp"]), field("bids_received", twin["bids"])]
    return F.when(twin.isNotNull(), entry("sigma", F.concat(F.lit("row "), F.coalesce(twin["source_id"], F.lit("?"))), fields=fields))


#: Fields of a contract that findings on many contracts cite.
SIGMA_CONTRACT = ("id", "unp", "subject", "contractor", "contractor_eik", "value_eur", "signed_at")
MEMBER = ("ContractNumber", "TenderNumber", "ContractDate", "ContractValue", "Currency", "SupplierName", "RegisterNumberList")


def contract_sources(contract: Sequence[str] | None = None, tender: Sequence[str] | None = None, second: Sequence[str] | None = None, note: Column | None = None) -> Column:
    """The entries of a contract by the register it stands in, with the named fields (None: all; an empty list leaves an entry out). A contract without records gets an entry all the same."""
    eop = [(_has_contract(), eop_contract(contract, note))] * (contract is None or len(contract) > 0) + [(_has_tender(), eop_tender(tender))] * (tender is None or len(tender) > 0)
    any_ = reduce(Column.__or__, (where for where, _ in eop), F.lit(False))
    bare = entry("record", F.col("subject"), url=F.col("url"), note=note)
    return F.when(F.col("source") == "sigma", F.array(sigma(second, note))).when(any_, listed(*eop, of=SOURCE)).otherwise(F.array(bare))


def reports_page(url: Column, expected: Column, note: Column | None = None) -> Column:
    """The page on which a report that is missing was looked for."""
    return entry("reports_page", F.concat(F.lit("reports page, looked for "), D.period(expected)), url=url, period=expected, note=note)


def flag(rule: Column, subject_key: Column, label: Column) -> Column:
    """Another finding."""
    return entry("flag", label, fields=[field("rule", rule), field("subject_key", subject_key)])


def registry(eik: Column, name: Column, url: Column, **fields: Column) -> Column:
    return entry("registry", F.concat_ws(" ", name, F.concat(F.lit("("), eik, F.lit(")"))), url=url, fields=[field(k, v) for k, v in fields.items()])


def declaration(name: Column, mandate: Column, url: Column, text: Column | None = None, note: Column | None = None) -> Column:
    return entry("declaration", F.concat_ws(", ", name, mandate), url=url, fields=[] if text is None else [field("declared", text)], note=note)
