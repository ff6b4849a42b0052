"""Queries of the 26 checks and of lien identity over stand-in packets made from orders, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.operators import checks, liens

#: The wide row of a packet, in SQL that both engines read; min_pages, an array, is apart. Divisors differ, so that
#: every branch of every check is met.
_FIELDS = {
    "packet": "cast(o_orderkey as string)",
    "order_type": "case o_orderkey % 7 when 0 then 'Foreclosure' when 1 then 'Current Owner Search' when 2 then '2nd Lien' when 3 then ' two owner search' when 4 then 'One Owner Search' when 5 then 'Unheard Of' end",
    "owner_state": "case when o_custkey % 3 = 0 then 'CONFIRMED' else 'NEEDS_REVIEW' end",
    "deeds": "cast(o_custkey % 4 as int)",
    "chain": "case o_custkey % 5 when 0 then true when 1 then false end",
    "target": "case when o_custkey % 2 = 0 then 'lien' end",
    "selection_required": "o_custkey % 11 = 0",
    "target_amount": "case when o_custkey % 13 = 0 then 'Needs review' else '100.00' end",
    "target_amount_state": "case when o_custkey % 5 < 4 then 'CONFIRMED' else 'NOT_STATED' end",
    "target_position_state": "case o_custkey % 3 when 0 then 'CONFIRMED' when 1 then 'EXAMINER_CONFIRMED' else 'CANNOT_CONFIRM' end",
    "hoa": "case o_custkey % 4 when 0 then 'No HOA' when 1 then 'Oak Hills' when 2 then 'Needs review' else 'n/a' end",
    "hoa_state": "case when o_custkey % 7 < 5 then 'CONFIRMED' else 'NOT_STATED' end",
    "ccrs": "case when o_custkey % 6 = 0 then 'Needs review' else 'attached' end",
    "ccrs_state": "case when o_custkey % 8 < 5 then 'CONFIRMED' else 'NOT_STATED' end",
    "hoa_detail": "o_custkey % 9 < 4",
    "summary_pairs": "cast(o_orderkey % 3 as int)",
    "summary_detected": "o_orderkey % 5 > 0",
    "summary_mismatched": "cast(case when o_orderkey % 11 = 0 then 2 else 0 end as int)",
    "summary_omitted": "cast(case when o_orderkey % 13 = 0 then 1 else 0 end as int)",
    "summary_missing": "cast(case when o_orderkey % 4 = 0 then 1 else 0 end as int)",
    "pair_missing": "cast(case when o_orderkey % 20 = 0 then 1 else 0 end as int)",
    "amount_or_party_mismatch": "cast(case when o_orderkey % 6 = 0 then 1 else 0 end as int)",
    "legal_texts": "cast(o_custkey % 4 as int)",
    "legal_keys": "cast(o_custkey % 3 as int)",
    "mortgages": "cast(o_custkey % 3 as int)",
    "mers": "case o_custkey % 4 when 0 then 'none' when 1 then 'yes' else 'Needs review' end",
    "mers_state": "case when o_custkey % 5 < 3 then 'CONFIRMED' else 'NOT_STATED' end",
    "mers_party": "o_custkey % 6 = 5",
    "federal_tax": "case o_custkey % 5 when 0 then 'none' when 1 then 'IRS lien' else 'Not found' end",
    "federal_tax_state": "case when o_custkey % 4 < 3 then 'CONFIRMED' else 'NOT_STATED' end",
    "unknown_liens": "cast(case when o_custkey % 7 = 0 then 1 else 0 end as int)",
    "released_liens": "cast(case when o_custkey % 5 = 0 then 1 else 0 end as int)",
    "releases": "cast(case when o_custkey % 6 = 0 then 1 else 0 end as int)",
    "report_address": "case when o_custkey % 9 = 0 then 'Needs review' when o_custkey % 2 = 0 then '12 Oak Street' else '12 OAK ST.' end",
    "source_address": "case when o_custkey % 10 = 0 then 'Needs review' when o_custkey % 5 = 0 then '14 Oak St' else '12 oak st' end",
    "loan": "case when o_custkey % 8 > 0 then 'loan' end",
    "loan_recorded": "case when o_custkey % 7 = 1 then 'Needs review' else '2020-01-02' end",
    "loan_status": "case o_custkey % 4 when 0 then 'OPEN' when 1 then 'UNKNOWN' when 2 then 'RELEASED' end",
    "min_state": "case when o_custkey % 4 > 0 then 'CONFIRMED' else 'NOT_STATED' end",
    "page_start": "cast(2 as int)",
    "page_end": "cast(case when o_custkey % 11 > 0 then 5 end as int)",
    "sheet_detected": "o_orderkey % 8 = 0",
    "sheet_mismatched": "cast(case when o_orderkey % 16 = 0 then 1 else 0 end as int)",
    "sheet_omitted": "cast(case when o_orderkey % 24 = 0 then 1 else 0 end as int)",
    "sheet_missing": "cast(case when o_orderkey % 40 = 0 then 1 else 0 end as int)",
}
_MIN_PAGE = "cast(o_custkey % 8 as int)"


def check_evaluation(spark, d):
    wide = spark.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} as {k}" for k, e in _FIELDS.items()], f"array({_MIN_PAGE}) as min_pages")
    return checks.evaluate(wide)


#: Captions of recorded instruments, so that each family of the identity patterns is met and each exclusion of it.
CAPTIONS = [
    "Deed of Trust", "Mortgage", "Security Deed", "Notice of Trustee's Sale on Deed of Trust", "Corrective Deed of Trust", "Extension of Mortgage", "Cancellation of Mortgage", "Assignment of Deed of Trust", "Loan Modification Mortgage", "Forbearance of Mortgage", "Appointment of Substitute Trustee", "Release of Deed of Trust",
    "Warranty Deed", "Special Warranty Deed with Vendor's Lien", "Trustee's Deed", "Tax Deed", "Judgment", "Abstract of Judgment Lien", "Federal Tax Lien", "Notice and Statement of Lien", "Mechanic's Lien", "HOA Lien", "UCC Financing Statement", "UCC Termination", "Notice of Default", "Plat", "Needs review", "",
]


def lien_identity(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.element_at(F.array(*[F.lit(c) for c in CAPTIONS]), (F.col("o_orderkey") % len(CAPTIONS) + 1).cast("int")).alias("caption"))
    return o.select("o_orderkey", "caption", F.coalesce(liens.lien_class(F.col("caption")), F.lit("none")).alias("identity"))


QUERIES = {f.__name__: f for f in (check_evaluation, lien_identity)}

_SAID = "({0}_state='CONFIRMED' and {0}<>'Needs review')"
_NO = "regexp_matches(trim({0}),'(?i)^(no|none|not applicable|n/a|not found)([^a-z0-9_]|$)')"
_TWO, _CUR = "lower(trim(coalesce(order_type,'')))='2nd lien'", "lower(trim(coalesce(order_type,'')))='current owner search'"
_SHEET = "case when {0}_mismatched>0 or {0}_omitted>0 then 'FAIL' when {0}_missing>0 then 'CANNOT_CONFIRM' else 'PASS' end"
_HOME = "regexp_replace(regexp_replace(lower({0}),'\\bstreet\\b|\\bst\\.','st','g'),'[^a-z0-9]','','g')"


def _ok(cond: str, no: str = "CANNOT_CONFIRM") -> str:
    return f"case when {cond} then 'PASS' else '{no}' end"


#: Written from the meaning of each check, in the order of their registry.
_STATUS = {
    "CURRENT_OWNER_ESTABLISHED": _ok("owner_state='CONFIRMED'"),
    "PRIOR_OWNER_ESTABLISHED": _ok(f"not {_CUR} and deeds>=2"),
    "OWNERSHIP_CHAIN_COMPLETE": f"case when {_CUR} or chain is null then 'CANNOT_CONFIRM' when chain then 'PASS' else 'FAIL' end",
    "TARGET_LIEN_FOUND": _ok("not selection_required and target is not null"),
    "TARGET_LIEN_AMOUNT": _ok("target is not null and target_amount_state='CONFIRMED' and target_amount<>'Needs review'"),
    "TARGET_LIEN_POSITION_ESTABLISHED": _ok("target_position_state in ('CONFIRMED','EXAMINER_CONFIRMED')"),
    "HOA_STATUS_REVIEWED": f"case when {_TWO} then 'NOT_APPLICABLE' when {_SAID.format('hoa')} then 'PASS' else 'CANNOT_CONFIRM' end",
    "CCRS_REVIEWED": f"case when {_TWO} then 'NOT_APPLICABLE' when {_SAID.format('ccrs')} then 'PASS' else 'CANNOT_CONFIRM' end",
    "HOA_NAME_AMOUNTS_REVIEWED": f"case when {_TWO} or ({_SAID.format('hoa')} and {_NO.format('hoa')}) then 'NOT_APPLICABLE' when hoa_detail then 'PASS' else 'CANNOT_CONFIRM' end",
    "DEED_MORTGAGE_ACCURACY": "case when not summary_detected or summary_pairs=0 or pair_missing>0 then 'CANNOT_CONFIRM' when amount_or_party_mismatch>0 then 'FAIL' else 'PASS' end",
    "RECORDED_DOCUMENTS_RECONCILE": f"case when not summary_detected then 'CANNOT_CONFIRM' else {_SHEET.format('summary')} end",
    "RECORDING_ORDER_RECONCILES": "'CANNOT_CONFIRM'",
    "ASSIGNMENT_CHAIN_COMPLETE": "'CANNOT_CONFIRM'",
    "LEGAL_DESCRIPTION_RECONCILES": _ok("legal_texts>=2 and legal_keys=1"),
    "MERS_BENEFICIARY_REVIEWED": f"case when mortgages=0 then 'NOT_APPLICABLE' when {_SAID.format('mers')} or mers_party then 'PASS' else 'CANNOT_CONFIRM' end",
    "FEDERAL_TAX_LIEN_REVIEWED": f"case when {_SAID.format('federal_tax')} and {_NO.format('federal_tax')} then 'NOT_APPLICABLE' else 'CANNOT_CONFIRM' end",
    "RELEASES_RECONCILED": "case when unknown_liens>0 then 'CANNOT_CONFIRM' when releases>0 or released_liens>0 then 'PASS' else 'NOT_APPLICABLE' end",
    "PROPERTY_IDENTITY_RECONCILES": f"case when loan is null or report_address='Needs review' or source_address='Needs review' then 'CANNOT_CONFIRM' when {_HOME.format('report_address')}={_HOME.format('source_address')} then 'PASS' else 'FAIL' end",
    "LOAN_DOCUMENT_TYPE_REVIEWED": _ok("loan is not null"),
    "LOAN_RECORDING_DATE_REVIEWED": _ok("loan is not null and loan_recorded<>'Needs review'"),
    "LOAN_STATUS_REVIEWED": _ok("loan is not null and coalesce(loan_status,'UNKNOWN')<>'UNKNOWN'"),
    "RECOURSE_REVIEWED": "'NOT_APPLICABLE'",
    "MATERIAL_REPORT_ERRORS_REVIEWED": "case when summary_mismatched>0 or summary_omitted>0 then 'FAIL' when summary_missing>0 or not summary_detected then 'CANNOT_CONFIRM' else 'PASS' end",
    "PLAT_REQUIREMENT_REVIEWED": "'CANNOT_CONFIRM'",
    "MIN_RUN_SHEET_REVIEWED": f"case when mortgages=0 or ({_SAID.format('mers')} and {_NO.format('mers')}) then 'NOT_APPLICABLE' when min_state='CONFIRMED' and min_page between page_start and page_end then 'PASS' else 'CANNOT_CONFIRM' end",
    "RUN_SHEET_RECONCILES": f"case when sheet_detected then {_SHEET.format('sheet')} when not summary_detected then 'CANNOT_CONFIRM' else {_SHEET.format('summary')} end",
}
_OWN = " or ".join(f"(lower(trim(coalesce(order_type,'')))='{kind.lower()}' and x.k in ({','.join(repr(c) for c in extra)}))" for kind, extra in D.PROFILES.items())
_KNOWN = ",".join(f"'{k.lower()}'" for k in D.PROFILES)
_ALL = ",".join(f"{{'k':'{k}','s':{e}}}" for k, e in _STATUS.items())

ORACLES = {
    "check_evaluation": f"with w as (select {', '.join(f'{e} as {k}' for k, e in _FIELDS.items())}, {_MIN_PAGE} as min_page from orders), l as (select packet, order_type, unnest([{_ALL}]) x from w)"
    f" select packet, x.k check_id, x.s status from l where x.k in ({','.join(repr(c) for c in D.NUMBERED)}) or {_OWN} or (lower(trim(coalesce(order_type,''))) not in ({_KNOWN}) and x.k='CURRENT_OWNER_ESTABLISHED')",
    "lien_identity": "with o as (select o_orderkey, [" + ",".join("'" + c.replace("'", "''") + "'" for c in CAPTIONS) + f"][o_orderkey%{len(CAPTIONS)}+1] caption from orders),"
    " e as (select *, lower(caption) t from o),"
    " b as (select *, t in ('','needs review') or regexp_matches(t,'release|satisfaction|reconveyance|discharge|termination|cancel') or regexp_matches(t,'assignment|modification|amendment|extension|renewal|subordination agreement|appointment|substitute trustee|substitution of trustee|notice of default|notice of trustee|notice of sale|foreclosure notice|correcti|forbearance') gone, regexp_matches(t,'mortgage|deed of trust|security deed') secured, regexp_matches(t,'\\bdeed\\b') conveys, regexp_matches(t,'judgment|\\blien\\b|ucc') owed from e)"
    " select o_orderkey, caption, case when gone then 'none' when secured then 'SECURITY' when conveys then 'none' when owed then 'OTHER' else 'none' end identity from b",
}
