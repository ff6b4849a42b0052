"""Queries of assembled records over customers as packets and their orders as instruments and summary entries: the wide
row, the checks over it and the record's warnings, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import checks, record
from docketlab.plans import catalogue_cascade as C
from docketlab.plans import catalogue_checks as K

_PACKET = {
    "packet": "c_custkey", "order_type": "case c_custkey % 5 when 0 then 'Foreclosure' when 1 then ' foreclosure' when 2 then 'Two Owner Search' when 3 then '2nd Lien' end", "order_type_state": "case when c_custkey % 4 > 0 then 'CONFIRMED' else 'UNCONFIRMED' end",
    "asked_type": "case c_custkey % 8 when 0 then 'Foreclosure' when 1 then 'Auto Detect' end", "detected": "c_custkey % 10 > 0", "page_start": "cast(1 as int)", "page_end": "cast(5 as int)", "labelled": "c_custkey % 3 = 0",
}
#: Value and state of each fact; packets with c_custkey % 13 = 0 have none.
_FACT = {
    "owner": ("'Jo'", "case when c_custkey % 3 = 0 then 'CONFIRMED' else 'UNCONFIRMED' end"), "address": ("case c_custkey % 4 when 1 then '12 oak st' when 2 then '12 Oak Street' when 3 then 'needs review' end", "'CONFIRMED'"),
    "legal": ("case c_custkey % 5 when 0 then 'LOT 1 Oak block' when 1 then 'Needs review' end", "'CONFIRMED'"), "hoa": ("case c_custkey % 3 when 0 then 'No HOA' when 1 then 'Oak HOA' end", "case when c_custkey % 4 > 0 then 'CONFIRMED' else 'NOT_STATED' end"),
    "ccrs": ("case when c_custkey % 6 > 0 then 'attached' end", "case when c_custkey % 5 > 0 then 'CONFIRMED' else 'NOT_STATED' end"), "federal_tax": ("case c_custkey % 3 when 0 then 'none' when 1 then 'IRS lien' end", "'CONFIRMED'"),
    "mers": ("case c_custkey % 5 when 0 then 'none' when 1 then 'yes' end", "case when c_custkey % 5 < 3 then 'CONFIRMED' else 'NOT_STATED' end"), "min": ("case when c_custkey % 4 > 0 then '1000' end", "case when c_custkey % 3 > 0 then 'CONFIRMED' else 'UNCONFIRMED' end"),
    "target_number": ("concat('INST ', cast(c_custkey % 8 as string))", "case when c_custkey % 3 = 0 then 'UNCONFIRMED' else 'NOT_STATED' end"), "target_position": ("'1st Lien'", "case when c_custkey % 7 = 0 then 'CONFIRMED' else 'NOT_STATED' end"),
}
_INSTRUMENT = C._SOURCE | {
    "status": "case o_orderkey % 6 when 0 then 'Open' when 1 then 'Paid in full' when 2 then 'unreleased' when 3 then 'see note' end", "address": "case o_orderkey % 3 when 0 then '12 Oak Street' when 1 then '12 OAK ST.' else 'Needs review' end",
    "p3": "case when o_orderkey % 3 > 0 and o_orderkey % 17 = 0 then 'MERS' end", "ref1": "case when o_orderkey % 4 = 0 then concat('inst ', cast((o_orderkey + 1) % 8 as string)) end",
    "quotes": "case o_orderkey % 10 when 0 then 'this judgment lien was released' when 1 then concat('re INST-', cast(o_orderkey % 8 as string)) else 'text' end", "verified": "o_orderkey % 11 > 1",
}
_ENTRY = C._ENTRY | {"category": "case when o_orderkey % 3 = 0 then 'Deeds' else 'Other' end", "verified": "o_orderkey % 3 > 0"}


def _inputs(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet")
    packets = customer.selectExpr(*[f"{e} as {k}" for k, e in _PACKET.items()])
    one = [F.struct(F.lit(n).alias("name"), F.expr(v).cast("string").alias("value"), F.expr(s).alias("state"), F.array((F.col("c_custkey") % 9).cast("int")).alias("pages")) for n, (v, s) in _FACT.items()]
    facts = customer.where("c_custkey % 13 > 0").select(F.col("c_custkey").alias("packet"), F.explode(F.array(*one)).alias("x")).select("packet", "x.*")
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} as {k}" for k, e in _INSTRUMENT.items()]).withColumnRenamed("source", "instrument")
    party = lambda n, r: F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("name"), F.lit(r).alias("role")))
    rows = rows.withColumns({"parties": F.array_compact(F.array(party("p1", "Grantee"), party("p2", "Grantor"), party("p3", "Nominee"))), "refs": F.array_compact(F.array("ref1")), "evidence": F.array_compact(F.array("e1"))})
    return packets, facts, rows.drop("p1", "p2", "p3", "ref1", "e1"), C._rows(spark, d, _ENTRY, {"evidence": ["e1"]}), C._rows(spark, d, C._REFERENCE, {})


def record_wide(spark, d):
    return record.wide(*_inputs(spark, d)).withColumn("min_pages", F.array_join(F.transform("min_pages", lambda p: p.cast("string")), ","))


def record_checks(spark, d):
    return checks.evaluate(record.wide(*_inputs(spark, d)))


QUERIES = {f.__name__: f for f in (record_wide, record_checks)}

_FACTS = ", ".join(f"case when c_custkey%13>0 then {v} end f_{n}, case when c_custkey%13>0 then {s} else 'NOT_STATED' end {n}_state" for n, (v, s) in _FACT.items())
_DETECTED = " where packet % 10 > 0"
_L = C._letters
_SAY = "coalesce(nullif({0},''),'Needs review')"
_WIDE = f"""{C._cascade(_DETECTED)}, {C._LEFT.replace("from s0 where", "from s0 where packet%10>0 and")}, {C._COUNTS.replace("r where not exists", "r where r.packet%10>0 and not exists")},
 p as (select {', '.join(f'{e} as {k}' for k, e in _PACKET.items())}, {_FACTS} from customer),
 h as (select * replace (case when asked_type='Foreclosure' then 'Foreclosure' when order_type_state='CONFIRMED' then coalesce(trim(order_type),'Needs review') else 'Needs review' end as order_type) from p),
 x as (select *, {_L('number')} "key", case when kind in ('Deed of Trust','Mortgage') then 'SECURITY' when kind='Judgment Lien' then 'OTHER' end class, try_cast({C._date(C._clean('recorded'))} as date) iday, {C._date(f"(case when {C._clean('recorded')}<>'' then {C._clean('recorded')} else documented end)")} dated, try_cast(nullif(regexp_replace(coalesce(number,''),'[^0-9]','','g'),'') as bigint) seq from (select {', '.join(f'{e} as {k}' for k, e in _INSTRUMENT.items())} from orders)),
 ea as (select *, {_L('number')} "key", kind in ('Deed of Trust','Mortgage') sec from (select {', '.join(f'{e} as {k}' for k, e in _ENTRY.items())} from orders)),
 st as (select x.*, coalesce((select bool_or(sec) from ea where ea.packet=x.packet and ea."key"=x."key" and ea."key"<>'' and ea.kind in ('Deed of Trust','Mortgage','Judgment Lien')), null) listed,
   case when class is null then null when not verified then 'UNKNOWN'
    when exists (select 1 from x r where r.packet=x.packet and r.kind='Release' and r.verified and x."key"<>'' and ({_L('r.ref1')}=x."key" or r."key"=x."key" or contains({_L('r.quotes')}, x."key"))) then 'RELEASED'
    when kind='Judgment Lien' and quotes='this judgment lien was released' then 'RELEASED' when status='Paid in full' then 'RELEASED' when status in ('Open','unreleased') then 'OPEN'
    when exists (select 1 from ea where ea.packet=x.packet and ea."key"=x."key" and x."key"<>'' and ea.kind in ('Deed of Trust','Mortgage','Judgment Lien')) then 'OPEN' else 'UNKNOWN' end stat from x),
 rk as (select *, row_number() over (partition by packet, stat order by iday nulls last, seq nulls last, source) turn from st),
 ps2 as (select *, case when stat='OPEN' and iday is not null and not exists (select 1 from rk u where u.packet=rk.packet and u.stat='UNKNOWN' and (u.iday is null or u.iday<=rk.iday))
   and not ((select count(*) from rk u where u.packet=rk.packet and u.stat='OPEN' and u.iday=rk.iday)>1 and exists (select 1 from rk u where u.packet=rk.packet and u.stat='OPEN' and u.iday=rk.iday and u.seq is null)) then turn end place from rk),
 auto as (select packet, case when bool_or(class='SECURITY' and stat='UNKNOWN') then null when count(*) filter (o)=1 then min(source) filter (o) when count(*) filter (o and not coalesce(listed,false))=0 then min(source) filter (o and place=1) end automatic from (select *, class='SECURITY' and stat='OPEN' o from ps2) group by 1),
 tg as (select h.packet, coalesce((select arg_min(source, (pos, source)) from ps2 where ps2.packet=h.packet and class='SECURITY' and "key"<>'' and "key"={_L('h.f_target_number')} and h.target_number_state<>'NOT_STATED'), case when lower(trim(h.order_type))='foreclosure' then automatic end) target, (select case when count(*)=1 then min(source) end from ps2 where ps2.packet=h.packet and class='SECURITY') sole from h left join auto on auto.packet=h.packet),
 dd as (select *, lead({{'a': p2}}) over (partition by packet order by try_cast(dated as date) nulls last, pos) nxt from x where kind in ('Warranty Deed','Assessor Deed','Trustee Deed')),
 ch as (select packet, bool_and({_L('p1')}={_L('nxt.a')}) filter (p1 is not null and nxt.a is not null) chain from dd group by 1),
 ag as (select packet, count(*) filter (kind in ('Warranty Deed','Assessor Deed','Trustee Deed')) deeds, count(*) filter (class='SECURITY') mortgages, list(distinct {_L('legal')}) filter (class='SECURITY' or kind in ('Warranty Deed','Assessor Deed','Trustee Deed')) legals, count(*) filter (class='SECURITY' or kind in ('Warranty Deed','Assessor Deed','Trustee Deed')) texts, coalesce(bool_or(class='SECURITY' and p3='MERS'),false) mers_party, count(*) filter (stat='UNKNOWN') unknown_liens, count(*) filter (stat='RELEASED') released_liens, count(*) filter (kind='Release') releases, coalesce(bool_or(class='SECURITY' and stat in ('OPEN','UNKNOWN')),false) unsettled from ps2 group by 1),
 pr as (select m.packet, count(*) n, count(*) filter (f.status='SOURCE_MISSING') gone, count(*) filter (f.fields like '%Amount%' or f.fields like '%Parties%') off from m join f on f.packet=m.packet and f.entry=m.entry join ea on ea.packet=m.packet and ea.entry=m.entry where regexp_matches(ea.category||' '||coalesce(ea.kind,''),'(?i)deed|mortgage') group by 1),
 am as (select packet, "key", arg_min({{'a': amount, 'v': verified}}, (ord, entry)) e from ea where "key"<>'' group by 1,2),
 w as (select h.packet, h.order_type, owner_state, coalesce(deeds,0) deeds, chain, t.source target, coalesce(lower(trim(h.order_type))='foreclosure' and tg.target is null and unsettled,false) selection_required,
  coalesce(t.amount, case when t.source is not null then am.e.a end, 'Needs review') target_amount, case when t.amount is not null then (case when t.verified then 'CONFIRMED' else 'UNCONFIRMED' end) when t.source is not null and am.e is not null then (case when am.e.v then 'CONFIRMED' else 'UNCONFIRMED' end) else 'NOT_STATED' end target_amount_state,
  case when target_position_state='CONFIRMED' then 'CONFIRMED' when t.place is null then 'NOT_STATED' else 'CONFIRMED' end target_position_state,
  {_SAY.format('f_hoa')} hoa, hoa_state, {_SAY.format('f_ccrs')} ccrs, ccrs_state, false hoa_detail, coalesce(pr.n,0) summary_pairs, detected summary_detected, case when detected then coalesce(mismatched,0) else 0 end summary_mismatched, case when detected then coalesce(omitted,0) else 0 end summary_omitted, case when detected then coalesce(source_missing,0)+coalesce(unavailable,0) else 0 end summary_missing, coalesce(gone,0) pair_missing, coalesce(off,0) amount_or_party_mismatch,
  coalesce(texts,0)+coalesce((f_legal='LOT 1 Oak block')::int,0) legal_texts, len(list_distinct(list_concat(coalesce(legals,[]), case when f_legal='LOT 1 Oak block' then ['lot1oakblock'] else [] end))) legal_keys, coalesce(mortgages,0) mortgages, {_SAY.format('f_mers')} mers, mers_state, coalesce(mers_party,false) mers_party, {_SAY.format('f_federal_tax')} federal_tax, federal_tax_state, coalesce(unknown_liens,0) unknown_liens, coalesce(released_liens,0) released_liens, coalesce(releases,0) releases,
  case when f_address like '12%' then f_address else 'Needs review' end report_address, coalesce(lo.address,'Needs review') source_address, lo.source loan, coalesce(lo.recorded,'Needs review') loan_recorded, lo.stat loan_status, case when f_min is null then 'NOT_STATED' else min_state end min_state, case when c_13 then h.packet%9 end min_page,
  case when detected then page_start end page_start, case when detected then page_end end page_end, detected and labelled sheet_detected
  from (select *, packet%13>0 c_13 from h) h left join tg on tg.packet=h.packet left join ag on ag.packet=h.packet left join ps2 t on t.packet=h.packet and t.source=tg.target left join ps2 lo on lo.packet=h.packet and lo.source=coalesce(tg.target, tg.sole) left join ch on ch.packet=h.packet left join c on c.packet=h.packet left join o on o.packet=h.packet left join l on l.packet=h.packet left join pr on pr.packet=h.packet left join am on am.packet=h.packet and am."key"=t."key"),
 wide as (select *, summary_mismatched sheet_mismatched, summary_omitted sheet_omitted, summary_missing sheet_missing from w)"""

#: The profiles, written out.
_PROFILE = "(lower(trim(order_type)) in ('two owner search') and x.k in ('CURRENT_OWNER_ESTABLISHED','PRIOR_OWNER_ESTABLISHED','OWNERSHIP_CHAIN_COMPLETE')) or (lower(trim(order_type))='2nd lien' and x.k in ('CURRENT_OWNER_ESTABLISHED','OWNERSHIP_CHAIN_COMPLETE')) or (lower(trim(order_type))='foreclosure' and x.k in ('CURRENT_OWNER_ESTABLISHED','OWNERSHIP_CHAIN_COMPLETE','TARGET_LIEN_FOUND','TARGET_LIEN_AMOUNT','TARGET_LIEN_POSITION_ESTABLISHED')) or (lower(trim(coalesce(order_type,'Needs review')))='needs review' and x.k='CURRENT_OWNER_ESTABLISHED')"
_TWENTY = "('HOA_STATUS_REVIEWED','CCRS_REVIEWED','HOA_NAME_AMOUNTS_REVIEWED','DEED_MORTGAGE_ACCURACY','RECORDED_DOCUMENTS_RECONCILE','RECORDING_ORDER_RECONCILES','ASSIGNMENT_CHAIN_COMPLETE','LEGAL_DESCRIPTION_RECONCILES','MERS_BENEFICIARY_REVIEWED','FEDERAL_TAX_LIEN_REVIEWED','RELEASES_RECONCILED','PROPERTY_IDENTITY_RECONCILES','LOAN_DOCUMENT_TYPE_REVIEWED','LOAN_RECORDING_DATE_REVIEWED','LOAN_STATUS_REVIEWED','RECOURSE_REVIEWED','MATERIAL_REPORT_ERRORS_REVIEWED','PLAT_REQUIREMENT_REVIEWED','MIN_RUN_SHEET_REVIEWED','RUN_SHEET_RECONCILES')"
ORACLES = {
    "record_wide": f"with recursive {_WIDE} select * exclude (min_page), coalesce(min_page::varchar,'') min_pages from wide",
    "record_checks": f"with recursive {_WIDE}, l9 as (select packet, order_type, unnest([{K._ALL}]) x from wide) select packet, x.k check_id, x.s status from l9 where x.k in {_TWENTY} or {_PROFILE}",
}
