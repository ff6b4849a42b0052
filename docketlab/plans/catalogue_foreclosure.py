"""Queries of the foreclosure analysis over orders as liens of their customers' packets, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import foreclosure, liens

#: In SQL that both engines read; e1 and e2 make the list of evidence.
_LIEN = {
    "packet": "o_custkey", "lien": "o_orderkey",
    "status": "case when o_orderstatus = 'O' then 'OPEN' when o_orderstatus = 'P' and o_custkey % 3 = 0 then 'UNKNOWN' else 'RELEASED' end",
    "recorded": "case when o_orderkey % 29 > 0 then cast(concat(substr(cast(o_orderdate as string), 1, 7), '-01') as date) end", "sequence": "case when o_orderkey % 5 > 0 then o_orderkey end",
    "kind": "case o_orderkey % 7 when 0 then 'Federal Tax Lien' when 4 then 'HOA Lien' when 5 then 'Mechanic Lien' when 6 then 'UCC Financing Statement' else 'Deed of Trust' end",
    "number": "case when o_orderkey % 4 > 0 then concat('Inst. ', cast(o_orderkey % 10 as string)) else '' end", "amount": "concat('$', cast(o_orderkey % 1000 as string))",
    "e1": "case when o_orderkey % 6 > 0 then concat('e', cast(o_orderkey % 3 as string)) end", "e2": "case when o_orderkey % 6 > 1 then concat('ev', cast(o_orderkey as string)) end",
}
_PACKET = {
    "packet": "c_custkey", "target_amount": "case c_custkey % 4 when 0 then 'Needs review' when 1 then '' else '$1' end", "stated": "case c_custkey % 6 when 0 then '1st Lien' when 1 then 'needs review' when 2 then '2nd lien' end",
    "stated_backed": "c_custkey % 4 < 3", "selection_required": "c_custkey % 9 = 0", "required": "c_custkey % 7 > 0", "chosen": "c_custkey % 5 > 0",
}


def _placed(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} as {k}" for k, e in _LIEN.items()])
    rows = rows.withColumn("evidence", F.array_compact(F.array("e1", "e2"))).drop("e1", "e2")
    stack = liens.targeted(foreclosure.warned(liens.lien_stack(rows)), F.col("lien") % 2 == 0).withColumnRenamed("target", "automatic")
    packets = spark.read.parquet(f"{d}/customer.parquet").selectExpr(*[f"{e} as {k}" for k, e in _PACKET.items()])
    # the automatic target where one is asked for: a column of the stack, so it needs no join of its own
    auto = stack.groupBy("packet").agg(F.max("automatic").alias("automatic"))
    both = packets.join(auto, "packet", "left").withColumn("target", F.when(F.col("chosen"), F.col("automatic"))).drop("automatic", "chosen")
    return foreclosure.placed(both, stack.drop("automatic"))


def lien_warnings(spark, d):
    rows = _placed(spark, d).where("lien is not null")
    return rows.select("packet", "lien", "label", "confidence", "warning", F.col("place").cast("long").alias("place"))


def developed_position(spark, d):
    return foreclosure.developed_positions(_placed(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


def foreclosure_rules(spark, d):
    return foreclosure.requirements(_placed(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


def foreclosure_analysis(spark, d):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return foreclosure.analysis(_placed(spark, d)).select("packet", "status", "target", "value", "basis", "confidence", "open", join("senior"), join("junior"), "n")


QUERIES = {f.__name__: f for f in (lien_warnings, developed_position, foreclosure_rules, foreclosure_analysis)}

_W = {
    "UNDATED": "Recording date is unresolved, so first-in-time position cannot be calculated.",
    "STATUS": "One or more lien identities have unresolved open/released status and could affect this position; exact priority remains unresolved.",
    "DAY": "Multiple open encumbrances share the same recording date without a reliable recording sequence; exact priority needs examiner review.",
    "RELEASED": "Released/satisfied instrument is excluded from the open-lien priority stack.",
    "UNKNOWN": "Lien status is unresolved; this identity is excluded from the open-lien count and final priority until open/unreleased status is supported.",
    "TAX": "Tax-lien priority and foreclosure notice/redemption rules can override a simple recording-date ranking.",
    "MECHANIC": "Mechanics/construction lien priority can relate back to work dates and requires jurisdiction-specific review.",
    "HOA": "HOA/association lien priority can be affected by statutory super-priority rules and requires jurisdiction-specific review.",
    "UCC": "UCC priority depends on collateral and perfection rules; chronological recording is only a screening baseline.",
}
_KIND = f"case when kind='Federal Tax Lien' then '{_W['TAX']}' when kind='Mechanic Lien' then '{_W['MECHANIC']}' when kind='HOA Lien' then '{_W['HOA']}' when kind like 'UCC%' then '{_W['UCC']}' else '' end"
_SAID = f"""l as (select *, list_filter([e1,e2], lambda x: x is not null) evidence, {_KIND} special from (select {', '.join(f'{e} as {k}' for k, e in _LIEN.items())} from orders)),
 b as (select l.*, (select count(*) from l u where u.packet=l.packet and u.status='UNKNOWN' and (u.recorded is null or u.recorded<=l.recorded)) unsure, (select count(*) from l p where p.packet=l.packet and p.status='OPEN' and p.recorded=l.recorded) same, (select count(*) from l p where p.packet=l.packet and p.status='OPEN' and p.recorded=l.recorded and p.sequence is null) bare,
   row_number() over (partition by packet, status order by recorded nulls last, sequence nulls last, lien) turn from l),
 s as (select *, case when status='OPEN' and recorded is not null and unsure=0 and not (same>1 and bare>0) then turn end pos,
   case when status='RELEASED' then '{_W['RELEASED']}' when status='UNKNOWN' then '{_W['UNKNOWN']}' when recorded is null then '{_W['UNDATED']}' when unsure>0 then '{_W['STATUS']}' when same>1 and bare>0 then '{_W['DAY']}' else special end warning from b),
 t as (select *, case when pos is not null then pos||(case when pos%100 between 11 and 13 then 'th' when pos%10=1 then 'st' when pos%10=2 then 'nd' when pos%10=3 then 'rd' else 'th' end)||' Lien' when status='RELEASED' then 'Released' else 'Needs review' end label,
   case when status='RELEASED' then 'high' when pos is null then 'low' when special<>'' then 'medium' else 'high' end conf, row_number() over (partition by packet order by case status when 'OPEN' then 0 when 'UNKNOWN' then 1 else 2 end, pos nulls last, recorded nulls last, lien) place from s),
 auto as (select packet, case when bool_or(kind='Deed of Trust' and status='UNKNOWN') then null when count(*) filter (o)=1 then min(lien) filter (o) when count(*) filter (o and lien%2=1)=0 then min(lien) filter (o and pos=1 and conf='high') end automatic from (select *, kind='Deed of Trust' and status='OPEN' o from t) group by 1),
 p as (select c.*, case when chosen then automatic end target from (select {', '.join(f'{e} as {k}' for k, e in _PACKET.items())} from customer) c left join auto using (packet)),
 x as (select p.*, t.lien, t.pos, t.label, t.status, t.conf, t.warning, coalesce(lower(stated) not in ('needs review','') and stated_backed, false) explicit from p left join t on t.packet=p.packet and t.lien=p.target),
 v as (select *, status='OPEN' and pos is not null and not explicit in_time, case when status='OPEN' then target end open_target, case when status='OPEN' then pos end pos_at,
   case when explicit then stated when status='OPEN' and pos is not null then label else 'Needs review' end val, case when explicit then 'EXPLICIT' when status='OPEN' and pos is not null then 'FIRST_IN_TIME' else 'UNRESOLVED' end basis, case when explicit then 'high' when status='OPEN' and pos is not null then conf else 'low' end val_conf,
   case when explicit and label<>'Needs review' and lower(label)<>lower(stated) then 'Expressly stated position ('||stated||') differs from first-in-time screening position ('||label||'); examiner priority review required.' when explicit then coalesce(warning,'') when status='OPEN' and pos is not null then warning when coalesce(warning,'')<>'' then warning else 'Target lien is not resolved in the open-lien stack.' end val_warning from x)"""
_CODE = "case when regexp_replace(lower(number),'[^a-z0-9]','','g')<>'' then regexp_replace(lower(number),'[^a-z0-9]','','g') else t.lien::varchar end"
_ON = "from v join t on t.packet=v.packet where"
_LINE = "t.kind||' '||number||' · '||amount||'.'"
_RULES = f"""raw as (
 select packet, 'TARGET_LIEN_SELECTION' code, 'EVIDENCE' as type, 'BLOCKING' severity, 'Foreclosure target lien is unresolved.' title, coalesce((select flatten(list(t.evidence)) from t where t.packet=v.packet and t.status in ('OPEN','UNKNOWN')), []) evidence, 0 turn, 0 place from v where required and (selection_required or open_target is null)
 union all select v.packet, 'TARGET_LIEN_AMOUNT', 'EVIDENCE', 'BLOCKING', 'Target lien amount is unresolved.', t.evidence, 1, place {_ON} t.lien=open_target and required and lower(target_amount) in ('','needs review')
 union all select v.packet, 'TARGET_LIEN_POSITION', 'PRIORITY_REVIEW', 'BLOCKING', 'Target lien position cannot be developed from the available recording evidence.', t.evidence, 2, place {_ON} t.lien=open_target and required and lower(val)='needs review'
 union all select v.packet, 'PRIORITY_EXCEPTION_REVIEW', 'PRIORITY_REVIEW', 'REVIEW', t.warning, t.evidence, 3, place {_ON} t.lien=open_target and required and t.warning<>''
 union all select v.packet, 'FIRST_IN_TIME_CONFIDENCE', 'PRIORITY_REVIEW', 'REVIEW', 'Lien position is developed from first-in-time chronology but carries a priority exception or sequencing uncertainty.', t.evidence, 4, place {_ON} t.lien=open_target and required and basis='FIRST_IN_TIME' and val_conf<>'high'
 union all select v.packet, 'LIEN_STATUS_'||{_CODE}, 'EVIDENCE', 'REVIEW', 'Lien status unresolved: '||{_LINE}, t.evidence, 5, place {_ON} t.status='UNKNOWN'
 union all select v.packet, 'SENIOR_'||{_CODE}, 'PAYOFF_REVIEW', 'REVIEW', 'Senior open encumbrance: '||t.label||' · '||{_LINE}, t.evidence, 6, place {_ON} required and t.status='OPEN' and t.pos<v.pos_at
 union all select v.packet, 'JUNIOR_'||{_CODE}, 'NOTICE_REVIEW', 'REVIEW', 'Junior open encumbrance: '||t.label||' · '||{_LINE}, t.evidence, 7, place {_ON} required and t.status='OPEN' and t.pos>v.pos_at
 union all select v.packet, 'STACK_EXCEPTION_'||{_CODE}, 'PRIORITY_REVIEW', 'REVIEW', t.kind||' '||number||': '||t.warning, t.evidence, 8, place {_ON} required and t.status='OPEN' and t.warning<>'' and t.lien is distinct from open_target),
 r as (select packet, code, type, severity, title, array_to_string(list_sort(list_distinct(evidence)),',') evidence from raw qualify row_number() over (partition by packet, code order by turn desc, place desc)=1)"""
_ACTION = "case " + " ".join(f"when code like '{k}%' then '{v}'" for k, v in {
    "TARGET\\_LIEN\\_SELECTION": "Develop the controlling security lien from packet evidence before relying on amount, position, payoff, notice, or cure analysis. Examiner selection should be used only when the packet cannot support an automatic target.",
    "TARGET\\_LIEN\\_AMOUNT": "Confirm the original/recorded lien amount from the controlling security instrument or title-report source evidence.",
    "TARGET\\_LIEN\\_POSITION": "Resolve lien-status, recording-date, sequence, or priority evidence before foreclosure treatment is finalized.",
    "PRIORITY": "Apply the governing state/jurisdiction priority rule before treating the chronological stack as legal priority.",
    "FIRST": "Examiner should confirm the applicable priority exception before foreclosure referral/export is finalized.",
    "LIEN": "Determine whether this lien identity is open, released, satisfied, or otherwise no longer affecting title before relying on the final lien count or priority stack.",
    "SENIOR": "Confirm whether the foreclosure will remain subject to this senior interest or whether payoff, subordination, release, or other treatment is required for the intended foreclosure outcome.",
    "JUNIOR": "Confirm required notice, joinder, service, and foreclosure treatment for this junior interest under the governing jurisdiction and process.",
    "STACK": "Resolve the priority exception before relying on the lien-stack order for foreclosure treatment.",
}.items()).replace("\\_", "_") + " end action"

ORACLES = {
    "lien_warnings": f"with {_SAID} select packet, lien, label, conf confidence, warning, place from t",
    "developed_position": f"""with {_SAID},
 e as (select v.packet, id, min((t.place, i)) seen from v join (select packet, lien, pos, status, place, unnest(evidence) id, generate_subscripts(evidence,1) i from t) t on t.packet=v.packet and (case when in_time then t.status='OPEN' and t.pos<=v.pos_at else t.lien=v.target end) group by 1,2),
 g as (select packet, string_agg(id, ',' order by seen) evidence from e group by 1)
 select v.packet, target, val "value", basis, val_conf confidence, val_warning warning, coalesce(evidence,'') evidence from v left join g on g.packet=v.packet""",
    "foreclosure_rules": f"with {_SAID}, {_RULES} select packet, code, type, severity, title, {_ACTION}, evidence from r",
    "foreclosure_analysis": f"""with {_SAID}, {_RULES}, n as (select packet, count(*) n, bool_or(severity='BLOCKING') b from r group by 1),
 o as (select v.packet, count(t.lien) filter (t.status='OPEN') as open, string_agg(t.lien::varchar, ',' order by t.pos) filter (t.status='OPEN' and t.pos<v.pos_at) senior, string_agg(t.lien::varchar, ',' order by t.pos) filter (t.status='OPEN' and t.pos>v.pos_at) junior from v left join t on t.packet=v.packet group by 1)
 select v.packet, case when b then 'CURATIVE_REQUIRED' when n>0 then 'REVIEW' else 'READY' end status, open_target target, val "value", basis, val_conf confidence, o.open, coalesce(senior,'') senior, coalesce(junior,'') junior, coalesce(n,0) n from v join o on o.packet=v.packet left join n on n.packet=v.packet""",
}
