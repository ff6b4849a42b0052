"""Rule registries as small tables: page classes, lien patterns, checks, profiles, areas, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Page classes in order of precedence, over lower-case text.
PAGE_CLASSES = [
    ("Bankruptcy / PACER", "pacer|bankrupt|chapter 7|chapter 11|chapter 13"),
    ("Assessor / Tax", "real estate assessment|assessor|tax year|tax ticket|property tax"),
    ("Trustee / Foreclosure Deed", "trustee'?s deed|substitute trustee|deed of foreclosure"),
    ("Mortgage / Deed of Trust", "deed of trust|mortgage"),
    ("Assignment", "assignment of|assignor|assignee"),
    ("Release / Satisfaction", "release|satisfaction|reconveyance"),
    ("Judgment / Lien", "judgment|lien|restitution|federal tax lien"),
    ("Legal Description", "legal description|beginning at|thence"),
    ("Run Sheet / Abstractor Sheet", "run sheet|abstractor sheet"),
    ("Title Report", "title\\s*search\\s*report|title report|search effective|client order"),
]
#: Order types and the wording that names them, in order of precedence.
ORDER_TYPES = [
    ("Two Owner Search", "(?i)\\b(?:2|two)\\s*[- ]?owner(?:\\s+search)?\\b"),
    ("2nd Lien", "(?i)\\b(?:2nd|second)\\s*[- ]?lien(?:\\s+search)?\\b"),
    ("Current Owner Search", "(?i)\\bcurrent\\s+owner(?:\\s+search)?\\b"),
    ("Foreclosure", "(?i)\\bforeclosure(?:\\s+search)?\\b"),
]
#: Statuses of a recorded interest. Word boundaries keep "unreleased" and "unpaid" open.
RELEASED_STATUS = "(?i)\\b(?:released?|satisf\\w*|paid|closed|terminated|reconveyed|discharged|cancelled)\\b"
OPEN_STATUS = "(?i)\\b(?:open|active|unreleased|outstanding|unsatisfied|unpaid|affect(?:s|ing)? title)\\b"
#: Captions that make an instrument a security lien, release one, follow from one, convey, or lien otherwise.
SECURITY = "(?i)mortgage|deed of trust|security deed"
RELEASE = "(?i)release|satisfaction|reconveyance|discharge|termination|cancel(?:led|lation)?"
DERIVATIVE = "(?i)assignment|modification|amendment|extension|renewal|subordination agreement|appointment|substitute trustee|substitution of trustee|trustee appointment|notice of default|notice of trustee(?:'s)? sale|notice of sale|foreclosure notice|corrective|correction|forbearance"
CONVEYANCE = "(?i)\\b(?:special warranty|general warranty|warranty|grant|quitclaim|quit claim|bargain(?: and| &) sale|trustee'?s?|sheriff'?s?|tax|executor'?s?|administrator'?s?)?\\s*deed\\b"
OTHER_LIEN = "(?i)judgment|notice and statement of lien|mechanic(?:'s)? lien|construction lien|hoa lien|association lien|assessment lien|ucc(?: financing statement)?|federal tax lien|tax lien|\\blien\\b"
#: Captions of priority exceptions, by kind.
EXCEPTIONS = [
    ("TAX", "(?i)federal tax|\\birs\\b|tax lien"),
    ("MECHANIC", "(?i)mechanic|construction"),
    ("ASSOCIATION", "(?i)hoa|association|assessment"),
    ("UCC", "(?i)ucc"),
]
#: What a stack entry warns of, by blocker, status and kind of priority exception.
WARNINGS = {
    "UNDATED": "Recording date is unresolved, so first-in-time position cannot be calculated.",
    "UNKNOWN_STATUS": "One or more lien identities have unresolved open/released status and could affect this position; exact priority remains unresolved.",
    "SAME_DAY": "Multiple open encumbrances share the same recording date without a reliable recording sequence; exact priority needs examiner review.",
    "RELEASED": "Released/satisfied instrument is excluded from the open-lien priority stack.",
    "UNKNOWN": "Lien status is unresolved; this identity is excluded from the open-lien count and final priority until open/unreleased status is supported.",
    "TAX": "Tax-lien priority and foreclosure notice/redemption rules can override a simple recording-date ranking.",
    "MECHANIC": "Mechanics/construction lien priority can relate back to work dates and requires jurisdiction-specific review.",
    "ASSOCIATION": "HOA/association lien priority can be affected by statutory super-priority rules and requires jurisdiction-specific review.",
    "UCC": "UCC priority depends on collateral and perfection rules; chronological recording is only a screening baseline.",
    "NO_TARGET": "Target lien is not resolved in the open-lien stack.",
}
#: Requirements, in the order they are raised: code (with _ at its end, the lien's number follows), type, severity, title (by the lien's fields), action.
REQUIREMENTS = [
    ("TARGET_LIEN_SELECTION", "EVIDENCE", "BLOCKING", "Foreclosure target lien is unresolved.", "Develop the controlling security lien from packet evidence before relying on amount, position, payoff, notice, or cure analysis. Examiner selection should be used only when the packet cannot support an automatic target."),
    ("TARGET_LIEN_AMOUNT", "EVIDENCE", "BLOCKING", "Target lien amount is unresolved.", "Confirm the original/recorded lien amount from the controlling security instrument or title-report source evidence."),
    ("TARGET_LIEN_POSITION", "PRIORITY_REVIEW", "BLOCKING", "Target lien position cannot be developed from the available recording evidence.", "Resolve lien-status, recording-date, sequence, or priority evidence before foreclosure treatment is finalized."),
    ("PRIORITY_EXCEPTION_REVIEW", "PRIORITY_REVIEW", "REVIEW", "{warning}", "Apply the governing state/jurisdiction priority rule before treating the chronological stack as legal priority."),
    ("FIRST_IN_TIME_CONFIDENCE", "PRIORITY_REVIEW", "REVIEW", "Lien position is developed from first-in-time chronology but carries a priority exception or sequencing uncertainty.", "Examiner should confirm the applicable priority exception before foreclosure referral/export is finalized."),
    ("LIEN_STATUS_", "EVIDENCE", "REVIEW", "Lien status unresolved: {kind} {number} · {amount}.", "Determine whether this lien identity is open, released, satisfied, or otherwise no longer affecting title before relying on the final lien count or priority stack."),
    ("SENIOR_", "PAYOFF_REVIEW", "REVIEW", "Senior open encumbrance: {label} · {kind} {number} · {amount}.", "Confirm whether the foreclosure will remain subject to this senior interest or whether payoff, subordination, release, or other treatment is required for the intended foreclosure outcome."),
    ("JUNIOR_", "NOTICE_REVIEW", "REVIEW", "Junior open encumbrance: {label} · {kind} {number} · {amount}.", "Confirm required notice, joinder, service, and foreclosure treatment for this junior interest under the governing jurisdiction and process."),
    ("STACK_EXCEPTION_", "PRIORITY_REVIEW", "REVIEW", "{kind} {number}: {warning}", "Resolve the priority exception before relying on the lien-stack order for foreclosure treatment."),
]
TYPE_GROUPS = ["deed of trust|mortgage|security deed", "assignment", "release|satisfaction|reconveyance", "judgment|lien", "trustee|foreclosure", "deed", "plat|survey"]

#: Id, issue code, issue severity, critical, question number of the 26 checks.
CHECKS = [
    ("CURRENT_OWNER_ESTABLISHED", "CURRENT_OWNER_UNRESOLVED", "BLOCKING", True, None),
    ("PRIOR_OWNER_ESTABLISHED", "PRIOR_OWNER_UNRESOLVED", "BLOCKING", True, None),
    ("OWNERSHIP_CHAIN_COMPLETE", "OWNERSHIP_CHAIN_GAP", "BLOCKING", True, None),
    ("TARGET_LIEN_FOUND", "TARGET_LIEN_UNRESOLVED", "BLOCKING", True, None),
    ("TARGET_LIEN_AMOUNT", "TARGET_LIEN_AMOUNT_UNRESOLVED", "BLOCKING", True, None),
    ("TARGET_LIEN_POSITION_ESTABLISHED", "LIEN_POSITION_UNRESOLVED", "BLOCKING", True, None),
    ("HOA_STATUS_REVIEWED", "HOA_STATUS_UNRESOLVED", "REVIEW", False, 1),
    ("CCRS_REVIEWED", "CCRS_UNRESOLVED", "REVIEW", False, 2),
    ("HOA_NAME_AMOUNTS_REVIEWED", "HOA_DETAILS_UNRESOLVED", "REVIEW", False, 3),
    ("DEED_MORTGAGE_ACCURACY", "DEED_MORTGAGE_ACCURACY", "BLOCKING", True, 4),
    ("RECORDED_DOCUMENTS_RECONCILE", "MISSING_OR_MISMATCHED_RECORDING", "BLOCKING", True, 5),
    ("RECORDING_ORDER_RECONCILES", "RECORDING_CHAIN_ORDER_ISSUE", "REVIEW", True, 6),
    ("ASSIGNMENT_CHAIN_COMPLETE", "ASSIGNMENT_CHAIN_GAP", "BLOCKING", True, 7),
    ("LEGAL_DESCRIPTION_RECONCILES", "LEGAL_DESCRIPTION_DISCREPANCY", "BLOCKING", True, 8),
    ("MERS_BENEFICIARY_REVIEWED", "MERS_BENEFICIARY_REVIEW", "REVIEW", False, 9),
    ("FEDERAL_TAX_LIEN_REVIEWED", "FEDERAL_TAX_LIEN_REVIEW", "BLOCKING", True, 10),
    ("RELEASES_RECONCILED", "RELEASE_SATISFACTION_ISSUE", "BLOCKING", True, 11),
    ("PROPERTY_IDENTITY_RECONCILES", "PROPERTY_IDENTITY_ISSUE", "BLOCKING", True, 12),
    ("LOAN_DOCUMENT_TYPE_REVIEWED", "LOAN_DOCUMENT_TYPE_UNRESOLVED", "REVIEW", False, 13),
    ("LOAN_RECORDING_DATE_REVIEWED", "LOAN_RECORDING_DATE_UNRESOLVED", "REVIEW", False, 14),
    ("LOAN_STATUS_REVIEWED", "LOAN_STATUS_UNRESOLVED", "REVIEW", True, 15),
    ("RECOURSE_REVIEWED", "RECOURSE_UNRESOLVED", "REVIEW", False, 16),
    ("MATERIAL_REPORT_ERRORS_REVIEWED", "MATERIAL_REPORT_ERROR", "QC", True, 17),
    ("PLAT_REQUIREMENT_REVIEWED", "PLAT_MAP_ISSUE", "QC", False, 18),
    ("MIN_RUN_SHEET_REVIEWED", "MIN_SUMMARY_ISSUE", "QC", False, 19),
    ("RUN_SHEET_RECONCILES", "RUN_SHEET_ACCURACY", "QC", True, 20),
]
NUMBERED = [c[0] for c in CHECKS if c[4]]
#: The checks without a number that each order type adds; other order types have the first.
PROFILES = {
    "One Owner Search": ["CURRENT_OWNER_ESTABLISHED"],
    "Current Owner Search": ["CURRENT_OWNER_ESTABLISHED", "PRIOR_OWNER_ESTABLISHED", "OWNERSHIP_CHAIN_COMPLETE"],
    "Two Owner Search": ["CURRENT_OWNER_ESTABLISHED", "PRIOR_OWNER_ESTABLISHED", "OWNERSHIP_CHAIN_COMPLETE"],
    "2nd Lien": ["CURRENT_OWNER_ESTABLISHED", "OWNERSHIP_CHAIN_COMPLETE"],
    "Foreclosure": ["CURRENT_OWNER_ESTABLISHED", "OWNERSHIP_CHAIN_COMPLETE", "TARGET_LIEN_FOUND", "TARGET_LIEN_AMOUNT", "TARGET_LIEN_POSITION_ESTABLISHED"],
}
#: The six audit areas and their checks; a check may be in several.
AREAS = {
    "VESTING": ["CURRENT_OWNER_ESTABLISHED", "PRIOR_OWNER_ESTABLISHED", "DEED_MORTGAGE_ACCURACY", "LEGAL_DESCRIPTION_RECONCILES"],
    "CHAIN": ["OWNERSHIP_CHAIN_COMPLETE", "RECORDING_ORDER_RECONCILES", "ASSIGNMENT_CHAIN_COMPLETE", "RECORDED_DOCUMENTS_RECONCILE"],
    "MORTGAGE": ["DEED_MORTGAGE_ACCURACY", "MERS_BENEFICIARY_REVIEWED", "RELEASES_RECONCILED", "PROPERTY_IDENTITY_RECONCILES", "LOAN_DOCUMENT_TYPE_REVIEWED", "LOAN_RECORDING_DATE_REVIEWED", "LOAN_STATUS_REVIEWED", "MIN_RUN_SHEET_REVIEWED"],
    "TAX": ["FEDERAL_TAX_LIEN_REVIEWED"],
    "JUDGMENTS_LIENS": ["RELEASES_RECONCILED", "RECORDED_DOCUMENTS_RECONCILE", "MATERIAL_REPORT_ERRORS_REVIEWED"],
    "EASEMENTS_RESTRICTIONS": ["CCRS_REVIEWED", "HOA_STATUS_REVIEWED", "HOA_NAME_AMOUNTS_REVIEWED", "PLAT_REQUIREMENT_REVIEWED"],
}
#: The stages in their one legal order; FAILED may follow any but COMPLETE.
STAGES = ["START", "INGEST", "EXTRACT", "CLASSIFY", "NORMALIZE", "CHECK", "GROUND", "RENDER", "RECORD", "COMPLETE"]


def checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHECKS, "check_id string, code string, severity string, critical boolean, question int")


def profile_checks(spark: SparkSession) -> DataFrame:
    """order_type, check_id; the order type 'Needs review' stands for any that is not known."""
    own = PROFILES | {"Needs review": PROFILES["One Owner Search"]}
    return spark.createDataFrame([(k, c) for k, extra in own.items() for c in extra + NUMBERED], "order_type string, check_id string")


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, c) for a, cs in AREAS.items() for c in cs], "area string, check_id string")
