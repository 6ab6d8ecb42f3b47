"""Thresholds of the rules, frozen; RULES_<NAME> in the environment or in a .env file (JSON or text) overrides one of them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

#: Fixed by law: leva to one euro.
PEG = 1.95583


# The limits that the law and the rules' definitions set.
@dataclass(frozen=True)
class Thresholds:
    late_deadline_days: int = 30
    late_grace_days: int = 7
    late_warning_days: int = 14
    late_high_days: int = 60
    annex_growth_ratio: float = 1.10
    annex_cap_ratio: float = 1.50
    annex_implausible_ratio: float = 5.0
    single_bidder_value: float = 100_000
    single_bidder_high: float = 500_000
    concentration_count: int = 3
    concentration_share: float = 0.15
    concentration_days: int = 730
    exceptional_warning: float = 100_000
    exceptional_high: float = 500_000
    deadline_margin_days: int = 5
    collecting_from: str = "2023-12-22"
    ceiling_low: float = 0.98
    ceiling_high: float = 1.05
    ceiling_value: float = 100_000
    ceiling_high_value: float = 500_000
    works_bands_bgn: tuple = ((80_000, 1), (300_000, 2), (10_526_116, 3))
    supplies_bands_bgn: tuple = ((50_000, 1), (100_000, 2), (273_812, 3))
    annex2_bands_bgn: tuple = ((100_000, 2), (1_466_850, 3))
    splitting_days: int = 365
    splitting_min: int = 2
    splitting_gap_days: int = 300
    splitting_high_ratio: float = 2.0
    near_share: float = 0.05
    near_from: str = "2024-01-01"
    quantity_value: float = 20_000
    quantity_warning: float = 100_000
    quantity_high: float = 500_000
    price_text_chars: int = 80
    overspend_ratio: float = 1.02
    overspend_abs: float = 10_000
    unplanned_spent: float = 10_000
    unplanned_excess: float = 10_000
    jump_ratio: float = 1.5
    jump_delta: float = 100_000
    new_object: float = 250_000
    direct_award_bgn: float = 50_000
    match_jaccard: float = 0.35
    match_low: float = 0.5
    match_high: float = 2.0
    reports_from: str = "2019-01"
    #: Address of the page on which reports are published, for the sources of missing ones.
    reports_page: str = ""
    related_high: float = 100_000
    person_count: int = 3
    person_total: float = 200_000
    person_high_count: int = 6
    person_high_total: float = 500_000
    young_days: int = 365
    young_high_days: int = 183
    young_value: float = 50_000
    young_high_value: float = 200_000
    status_years: int = 3
    status_value: float = 100_000
    status_lag_years: int = 2
    mismatch_value: float = 50_000
    # Fixed values: (activity divisions, contract division) that don't go together.
    mismatch_pairs: tuple = ((("55", "56", "68"), "45"), (("55", "56", "68"), "71"), (("64", "65", "66"), "45"), (("97", "98"), "45"))
    twin_tolerance: float = 0.02


# CPV prefixes of the services that have higher limits, by law.
ANNEX2_PREFIXES = ("75", "80", "85", "92", "55", "791", "797", "7995", "7961", "7962", "641", "9800", "9812", "9813", "9820", "9850", "98513", "98514", "989")

TIERS = {"late_publication": "violation", "annex_over_cap": "violation", "unplanned_spending": "violation", "missing_quantity": "opacity", "missing_value": "opacity", "price_unverifiable": "opacity", "near_threshold": "opacity", "missing_monthly_report": "opacity"}


def tier_of(rule: str) -> str:
    return TIERS.get(rule, "signal")


# Documented names of overrides where they differ from ours.
NAMES = {
    "late_publication_deadline_days": "late_deadline_days", "late_publication_grace_days": "late_grace_days",
    "late_publication_warning_days": "late_warning_days", "late_publication_high_days": "late_high_days",
    "overspend_abs_eur": "overspend_abs", "unplanned_min_spent_eur": "unplanned_spent", "unplanned_min_excess_eur": "unplanned_excess",
    "plan_jump_ratio": "jump_ratio", "plan_jump_abs_eur": "jump_delta", "new_object_min_eur": "new_object",
    "single_bidder_warning_eur": "single_bidder_value", "single_bidder_high_eur": "single_bidder_high",
    "concentration_min_contracts": "concentration_count", "concentration_window_days": "concentration_days",
    "direct_award_threshold_bgn": "direct_award_bgn", "match_jaccard_threshold": "match_jaccard",
    "match_value_ratio_low": "match_low", "match_value_ratio_high": "match_high", "annex_max_plausible_ratio": "annex_implausible_ratio",
    "missing_quantity_min_value_eur": "quantity_value", "missing_quantity_warning_eur": "quantity_warning", "missing_quantity_high_eur": "quantity_high",
    "price_unverifiable_min_description_chars": "price_text_chars", "zop_thresholds_effective_from": "near_from",
    "splitting_window_days": "splitting_days", "splitting_min_members": "splitting_min", "splitting_renewal_gap_days": "splitting_gap_days",
    "splitting_high_multiple": "splitting_high_ratio", "near_threshold_pct": "near_share",
    "exceptional_warning_eur": "exceptional_warning", "exceptional_high_eur": "exceptional_high",
    "collecting_offers_rule_effective_from": "collecting_from", "offer_evaluation_margin_days": "deadline_margin_days",
    "bid_ceiling_ratio": "ceiling_low", "bid_ceiling_max_ratio": "ceiling_high", "bid_ceiling_warning_eur": "ceiling_value", "bid_ceiling_high_eur": "ceiling_high_value",
    "reports_first_period": "reports_from", "related_party_high_eur": "related_high",
    "person_concentration_min_contracts": "person_count", "person_concentration_min_eur": "person_total",
    "person_concentration_high_contracts": "person_high_count", "person_concentration_high_eur": "person_high_total",
    "young_company_window_days": "young_days", "young_company_high_window_days": "young_high_days",
    "young_company_min_eur": "young_value", "young_company_high_eur": "young_high_value",
    "company_status_recent_years": "status_years", "company_status_min_eur_for_report": "status_value",
    "company_status_report_lag_years": "status_lag_years", "activity_mismatch_min_eur": "mismatch_value",
}
# Documented lists of boundaries; the levels that they require stay.
BOUNDS = {"zop_works_bounds_bgn": "works_bands_bgn", "zop_supplies_bounds_bgn": "supplies_bands_bgn", "zop_annex2_bounds_bgn": "annex2_bands_bgn"}


def dotenv(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file; nothing where there is none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.split("=", 1) for line in map(str.strip, f) if "=" in line and not line.startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def thresholds(environ=None) -> Thresholds:
    env = dotenv() | dict(os.environ) if environ is None else environ
    base, given = Thresholds(), {}
    for name in [*NAMES, *BOUNDS, *(f.name for f in fields(Thresholds))]:
        if (value := env.get(f"RULES_{name.upper()}")) is None:
            continue
        field = BOUNDS.get(name) or NAMES.get(name, name)
        read = value if isinstance(getattr(base, field), str) and not value.startswith('"') else json.loads(value)
        given[field] = [(b, level) for b, (_, level) in zip(read, getattr(base, field), strict=True)] if name in BOUNDS else read
    return replace(base, **{k: _frozen(v) for k, v in given.items()})


def _frozen(v):
    return tuple(map(_frozen, v)) if isinstance(v, (list, tuple)) else v
