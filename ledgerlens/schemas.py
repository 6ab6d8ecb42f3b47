"""Explicit schemas of the domain tables; nothing is inferred."""

from __future__ import annotations

MONEY, LEDGER = "decimal(16,2)", "decimal(18,2)"



class Schema(str):
    """A schema in Spark's DDL; usable wherever a schema string is, before any session exists."""

    def fieldNames(self) -> list[str]:
        depth, names, start = 0, [], 0
        for k, c in enumerate(self + ","):
            depth += (c in "<(") - (c in ">)")
            if c == "," and depth == 0:
                names.append(self[start:k].split()[0])
                start = k + 1
        return names


def _struct(ddl: str) -> Schema:
    return Schema(" ".join(ddl.split()))


#: Contracts of both registers; raw holds what rules read of the source records.
PROCUREMENTS = _struct(
    f"""id long, source string, source_id string, title string, cpv_code string, procedure_type string,
    estimated_value_bgn {MONEY}, estimated_value_eur {MONEY}, contract_value_bgn {MONEY}, contract_value_eur {MONEY}, currency string,
    contractor_name string, contractor_eik string, bids_received int, published_at timestamp, contract_date timestamp, url string,
    raw struct<
      contract: struct<ContractDate: string, TedPublishDate: string, TenderNumber: string, TypeOfContract: int, ContractSubject: string,
        ContractValue: double, Currency: int, CurrentContractValue: double, CurrentContractCurrency: int>,
      procedure: struct<EstimatedValue: double, Currency: int, IsEUFinanced: boolean, TypeOfContract: int, SpecialNumber: string,
        PublicationDate: string, OfferPhaseEndDate: string>,
      tender_detail: struct<TenderName: string, TenderDescription: string, notice_text: string, OfferPhaseStartDate: string,
        PublicationDate: string, OfferPhaseEndDate: string>,
      sigma: struct<unp: string, eu_funded: boolean, procedure: string>>"""
)

LEDGER_LINES = _struct(
    f"""report_id long, period string, unit string, function_code string, paragraph string, subparagraph string, object_code string,
    object_name string, years string, estimated_total {LEDGER}, spent_prior {LEDGER}, plan_current {LEDGER}, spent_period {LEDGER},
    currency string, row_type string, source_sheet string, source_row int"""
)

CASH_LINES = _struct(f"report_id long, period string, section string, paragraph string, name string, plan_annual {LEDGER}, plan_adjusted {LEDGER}, actual_ytd {LEDGER}, row_type string, parent_paragraph string")

REPORTS = _struct("id long, period string, kind string, url string, file_path string, mtime double")

COMPANIES = _struct(
    """eik string, name string, legal_form string, status string, nkid_code string, nkid_label string, source_url string, registered_at timestamp,
    last_annual_report_year int, last_no_activity_declaration_year int"""
)

COMPANY_PEOPLE = _struct("eik string, name string, name_normalized string, role string, share_text string, person_eik string, field_ident string, is_current boolean")

OFFICIALS = _struct(
    """name string, name_normalized string, role string, mandate string, source_url string, document_url string,
    declared_interests array<struct<company_name: string, eik: string, relation: string, raw: string>>"""
)

PARCELS = _struct("cadnum string, ekatte string, settlement string, street string, street_number string, usetype string, area_m2 double, centroid_lat double, centroid_lon double, geometry string, source_modified date")

SOURCE = "struct<kind: string, label: string, url: string, file: string, sheet: string, row: int, period: string, fields: array<struct<name: string, value: string, value_eur: double>>, note: string>"

#: What every rule returns.
FLAGS = _struct(f"rule string, tier string, severity string, message string, subject_type string, subject_id string, subject_key string, procurement_id long, details string, sources array<{SOURCE}>")
