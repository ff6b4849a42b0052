"""Queries of the six audit areas and of verdicts over customers as packets, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.operators import audit

#: In SQL that both engines read, by table.
_TABLES = {
    "packets": ("customer", {"packet": "c_custkey", "tax_state": "case when c_custkey % 3 = 0 then 'CONFIRMED' else 'NOT_STATED' end", "tax_status": "case when c_custkey % 2 = 0 then 'Paid' end", "fiscal_year": "cast(2000 + c_custkey % 20 as string)", "ccrs_state": "case when c_custkey % 4 < 2 then 'CONFIRMED' end", "ccrs": "case c_custkey % 5 when 0 then 'None' when 1 then ' no CCRs' when 2 then 'Recorded' end"}),
    "checks": ("(select o_custkey, o_orderkey % 26 k, min(o_orderkey) o from orders where o_custkey % 8 > 0 group by 1, 2)", {"packet": "o_custkey", "k": "cast(k as int)", "turn": "k", "label": "concat('Label ', cast(k as string))", "status": "case when o_custkey % 3 = 0 then 'PASS' when o % 7 = 0 then 'FAIL' when o % 7 = 1 then 'CANNOT_CONFIRM' when o % 7 = 2 then 'NOT_APPLICABLE' else 'PASS' end", "summary": "case when o % 5 > 0 then concat('said ', cast(o as string)) when o % 10 = 0 then '' end"}),
    "liens": ("orders", {"packet": "o_custkey", "place": "o_orderkey", "status": "case when o_orderstatus = 'F' then 'RELEASED' when o_orderstatus = 'O' and o_custkey % 2 = 0 then 'OPEN' when o_custkey % 5 = 0 then 'UNKNOWN' else 'RELEASED' end", "kind": "case when o_orderkey % 2 = 0 then 'Deed of Trust' end", "number": "cast(o_orderkey as string)"}),
    "references": ("orders", {"packet": "o_custkey", "kind": "case when o_orderkey % 40 = 0 then 'CC&R' end", "description": "case when o_orderkey % 41 = 0 then 'an Easement of record' else 'a deed' end"}),
}


def _frame(spark, d, name):
    source, fields = _TABLES[name]
    read = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "orders") if n in source}
    for n in read:
        source = source.replace(n, "{" + n + "}")
    return spark.sql(f"select {', '.join(f'{e} as {k}' for k, e in fields.items())} from {source}", **read)


def _checks(spark, d):
    ids = F.array(*[F.lit(c[0]) for c in D.CHECKS])
    return _frame(spark, d, "checks").withColumn("check_id", F.element_at(ids, F.col("k") + 1)).drop("k")


def six_audit_areas(spark, d):
    out = audit.six_areas(_frame(spark, d, "packets"), _checks(spark, d), _frame(spark, d, "liens"), _frame(spark, d, "references"))
    return out.withColumn("check_ids", F.array_join("check_ids", ","))


def verdict_reasons(spark, d):
    return audit.verdicts(_checks(spark, d))


QUERIES = {f.__name__: f for f in (six_audit_areas, verdict_reasons)}

#: The checks in their order and the areas' checks by their places in it, written out.
_IDS = "['CURRENT_OWNER_ESTABLISHED','PRIOR_OWNER_ESTABLISHED','OWNERSHIP_CHAIN_COMPLETE','TARGET_LIEN_FOUND','TARGET_LIEN_AMOUNT','TARGET_LIEN_POSITION_ESTABLISHED','HOA_STATUS_REVIEWED','CCRS_REVIEWED','HOA_NAME_AMOUNTS_REVIEWED','DEED_MORTGAGE_ACCURACY','RECORDED_DOCUMENTS_RECONCILE','RECORDING_ORDER_RECONCILES','ASSIGNMENT_CHAIN_COMPLETE','LEGAL_DESCRIPTION_RECONCILES','MERS_BENEFICIARY_REVIEWED','FEDERAL_TAX_LIEN_REVIEWED','RELEASES_RECONCILED','PROPERTY_IDENTITY_RECONCILES','LOAN_DOCUMENT_TYPE_REVIEWED','LOAN_RECORDING_DATE_REVIEWED','LOAN_STATUS_REVIEWED','RECOURSE_REVIEWED','MATERIAL_REPORT_ERRORS_REVIEWED','PLAT_REQUIREMENT_REVIEWED','MIN_RUN_SHEET_REVIEWED','RUN_SHEET_RECONCILES']"
_AREAS = "(values ('VESTING','Vesting Deed Information',[0,1,9,13]), ('CHAIN','Chain of Title',[2,11,12,10]), ('MORTGAGE','Mortgage Information',[9,14,16,17,18,19,20,24]), ('TAX','Tax Information',[15]), ('JUDGMENTS_LIENS','Judgments and Liens',[16,10,22]), ('EASEMENTS_RESTRICTIONS','Easements and Restrictions',[7,6,8,23])) a(area, label, ks)"


def _cte(name: str) -> str:
    source, fields = _TABLES[name]
    return f"t_{name} as (select {', '.join(f'{e} as {k}' for k, e in fields.items())} from {source})"


_DONE = "coalesce(array_to_string(list_transform(list_filter(cs, lambda x: x.s in ('FAIL','CANNOT_CONFIRM')), lambda x: x.l||': '||coalesce(x.m,'')),' | '),'')"
_REST = "coalesce(array_to_string(list_filter(list_transform(cs, lambda x: x.m), lambda m: coalesce(m,'')<>'')[1:3],' | '),'')"
_COMPACT = f"case when {_DONE}<>'' then {_DONE} when {_REST}<>'' then {_REST} else 'No applicable exception identified.' end"

ORACLES = {
    "six_audit_areas": f"""with {', '.join(_cte(n) for n in _TABLES)},
 g as (select p.*, a.area, a.label, list({{'k': c.k, 'l': c.label, 's': c.status, 'm': c.summary}} order by c.k) filter (c.k is not null) cs from t_packets p cross join {_AREAS} left join t_checks c on c.packet=p.packet and list_contains(a.ks, c.k) group by all),
 n as (select packet, count(*) filter (status='OPEN') o, count(*) filter (status='UNKNOWN') u, string_agg(concat_ws(' ', coalesce(kind,''), number), '; ' order by place) filter (status='OPEN') listed from t_liens group by 1),
 r as (select packet, bool_or(kind='CC&R' or description like '%Easement%') restricted from t_references group by 1),
 w as (select g.*, coalesce(o,0) o, coalesce(u,0) u, listed, tax_state='CONFIRMED' taxed, coalesce(restricted,false) or coalesce(ccrs_state='CONFIRMED' and ccrs='Recorded',false) present, len(list_filter(coalesce(cs,[]), lambda x: x.s='FAIL'))>0 f, len(list_filter(coalesce(cs,[]), lambda x: x.s='CANNOT_CONFIRM'))>0 c, {_COMPACT} said from g left join n on n.packet=g.packet left join r on r.packet=g.packet)
 select packet, area, label, case when f then 'DISCREPANCIES' when area='TAX' then (case when taxed then 'ACCURATE' else 'INCOMPLETE' end) when area='JUDGMENTS_LIENS' then (case when u>0 then 'DISCREPANCIES' when o>0 then 'PRESENT' else 'NONE' end) when c then 'INCOMPLETE' when area='EASEMENTS_RESTRICTIONS' then (case when present then 'PRESENT' else 'NONE' end) when area='CHAIN' then 'COMPLETE' else 'ACCURATE' end status,
  case when area='TAX' then (case when taxed then 'Tax status: '||coalesce(tax_status,'')||'; fiscal year: '||fiscal_year||'.' else 'Tax status/fiscal-year evidence is incomplete or unconfirmed.' end)
   when area='JUDGMENTS_LIENS' then (case when u>0 then o||' supported open lien(s); '||u||' lien identity/identities have unresolved open/released status.' when o>0 then o||' supported open lien(s): '||listed||'.' else 'No supported open lien identity remains in the developed stack.' end)
   when area='EASEMENTS_RESTRICTIONS' and present then 'Restriction/easement-related references are present. '||said else said end summary,
  coalesce(array_to_string(list_transform(cs, lambda x: {_IDS}[x.k+1]),','),'') check_ids from w""",
    "verdict_reasons": f"""with {_cte('checks')}, g as (select packet, count(*) filter (status='FAIL') f, count(*) filter (status='CANNOT_CONFIRM') c, list(label order by turn) filter (status='FAIL') named from t_checks group by 1)
 select packet, case when f+c>0 then 'Fail' else 'Pass' end status, case when f>0 then f||' confirmed QC failure'||(case when f=1 then '' else 's' end)||': '||array_to_string(named[1:3],'; ')||'.' when c>0 then c||' review item'||(case when c=1 then ' remains' else 's remain' end)||' unconfirmed; quality standards cannot be certified until resolved.' else 'All applicable review checks are resolved without an identified QC failure.' end reason,
  case when f>0 then 'The document contains the issues identified above and does not meet quality standards.' when c>0 then 'The document contains unresolved review items and cannot yet be certified as meeting quality standards.' else 'The document meets all quality standards with no identified issues.' end confirmation from g""",
}
