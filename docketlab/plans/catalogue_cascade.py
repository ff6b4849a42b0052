"""Queries of the reconciliation cascade over orders as summary entries and as sources of their customers' packets,
with SQL twins that take the entries' turns one recursion step at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import cascade

_KINDS = ["Deed of Trust", "Warranty Deed", "Assignment of Mortgage", "Release", "Judgment Lien", "", "Plat", "Assessor Deed", "Mortgage", "Needs review", "Trustee Deed"]
_DAY = "substr(cast(o_orderdate as string), 1, 10)"
_US = f"concat(substr({_DAY}, 6, 2), '/', substr({_DAY}, 9, 2), '/', substr({_DAY}, 1, 4))"
_PRICE = "cast(cast(o_totalprice as decimal(18,2)) as string)"


def _kind(i: str) -> str:
    return f"case {i} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(_KINDS)) + " end"


#: In SQL that both engines read; lists are built of e1 (evidence) and p1, p2 (parties).
_ENTRY = {
    "packet": "o_custkey", "entry": "o_orderkey", "ord": "o_orderkey % 97",
    "number": "case when o_orderkey % 4 < 2 then concat('inst ', cast((o_orderkey + 1) % 8 as string)) when o_orderkey % 4 = 2 then ' needs REVIEW ' end",
    "book_page": "case when o_orderkey % 3 = 1 then concat('BOOK ', cast(o_orderkey % 4 as string), ' PAGE 9') end",
    "kind": _kind("o_orderkey % 10"), "documented": f"case when o_orderkey % 2 = 0 then {_US} else {_DAY} end", "recorded": f"case when o_orderkey % 5 = 0 then 'January 5, 1995' else {_US} end",
    "amount": f"concat('$', {_PRICE})", "parties": "case o_orderkey % 4 when 0 then 'ACME Bank of Ohio' when 1 then 'Smith, John' when 2 then 'to' end",
    "legal": "concat('Lot ', cast(o_orderkey % 2 as string), ', the Oak Block')", "e1": "case when o_orderkey % 7 > 0 then concat('en_', cast(o_orderkey as string)) end",
}
_SOURCE = {
    "packet": "o_custkey", "source": "o_orderkey", "pos": "(o_orderkey * 7) % 101",
    "number": "case when o_orderkey % 5 < 3 then concat('INST-', cast(o_orderkey % 8 as string)) when o_orderkey % 5 = 3 then 'Needs review' end",
    "book_page": "case when o_orderkey % 3 > 0 then concat('Book ', cast(o_orderkey % 4 as string), ' / Page 9') end",
    "kind": _kind("o_orderkey % 11"), "documented": _DAY, "recorded": f"case when o_orderkey % 5 = 1 then '1/5/95' else {_DAY} end",
    "amount": f"case when o_orderkey % 9 > 0 then {_PRICE} end", "p1": "case when o_orderkey % 3 > 0 then 'Acme Bank' end", "p2": "case when o_orderkey % 6 < 4 then 'John Smith of Ohio' end",
    "legal": "concat('LOT ', cast(o_orderkey % 3 as string), ' Oak Block')", "e1": "case when o_orderkey % 11 > 0 then concat('ev_', cast(o_orderkey as string)) end",
}
_REFERENCE = {
    "packet": "o_custkey", "reference": "o_orderkey", "number": "case when o_orderkey % 3 = 0 then concat('Inst. ', cast((o_orderkey + 3) % 8 as string)) end",
    "book_page": "case when o_orderkey % 6 = 1 then concat('book ', cast((o_orderkey + 1) % 4 as string), ' page 9') end", "kind": _kind("(o_orderkey + 2) % 11"),
    "description": "case o_orderkey % 4 when 0 then 'the deed of record' when 1 then 'easement and plat map' when 2 then 'an old lien' end",
}


def _rows(spark, d, fields, lists):
    out = spark.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} as {k}" for k, e in fields.items()])
    return out.withColumns({name: F.array_compact(F.array(*cols)) for name, cols in lists.items()}).drop("e1", "p1", "p2")


def _inputs(spark, d):
    e = _rows(spark, d, _ENTRY, {"evidence": ["e1"]})
    s = _rows(spark, d, _SOURCE, {"evidence": ["e1"], "parties": ["p1", "p2"]})
    packets = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("packet"), (F.col("c_custkey") % 10 > 0).alias("detected"))
    return packets, e, s, _rows(spark, d, _REFERENCE, {})


def reconcile_cascade(spark, d):
    _, e, s, _ = _inputs(spark, d)
    out = cascade.reconciled(e, s)
    return out.select("packet", "entry", "source", "tier", "status", F.array_join("fields", "; ").alias("fields"), F.array_join("evidence", ",").alias("evidence"))


def reconcile_packets(spark, d):
    return cascade.reconcile(*_inputs(spark, d)).select("packet", "detected", "n", "matched", "mismatched", "source_missing", "omitted", "unavailable", "summary")


def reconcile_run_sheet(spark, d):
    packets, e, s, r = _inputs(spark, d)
    return cascade.reconcile(packets.withColumn("detected", F.col("packet") % 3 == 0), e.where("kind <> ''"), s, r, "Run Sheet").select("packet", "summary")


def unavailable_references(spark, d):
    _, _, s, r = _inputs(spark, d)
    return cascade.unavailable(r, s).select("packet", "reference")


QUERIES = {f.__name__: f for f in (reconcile_cascade, reconcile_packets, reconcile_run_sheet, unavailable_references)}


def _clean(x: str) -> str:
    return f"(case when lower(trim(coalesce({x},'')))='needs review' then '' else trim(coalesce({x},'')) end)"


def _letters(x: str) -> str:
    return f"regexp_replace(lower({_clean(x)}),'[^a-z0-9]','','g')"


def _words(x: str) -> str:
    return f"trim(regexp_replace(lower({_clean(x)}),'[^a-z0-9$#./''-]+',' ','g'))"


def _legal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_words(x)},'\\bthe\\b','','g'),' +',' ','g'))"


def _date(x: str) -> str:
    us = f"regexp_extract({x},'^(\\d+)/(\\d+)/(\\d+)$',['m','d','y'])"
    return f"coalesce(strftime(try_strptime({x},'%B %-d, %Y'),'%Y-%m-%d'), case when ({us}).y<>'' then (case when len(({us}).y)=2 then '20' else '' end)||({us}).y||'-'||lpad(({us}).m,2,'0')||'-'||lpad(({us}).d,2,'0') else {x} end)"


_GROUPS = ["deed of trust|mortgage|security deed", "assignment", "release|satisfaction|reconveyance", "judgment|lien", "trustee|foreclosure", "deed", "plat|survey"]


def _fit(a: str, b: str) -> str:
    both = " or ".join(f"(regexp_matches({a},'{g}') and regexp_matches({b},'{g}'))" for g in _GROUPS)
    return f"({a}='' or {b}='' or contains({a},{b}) or contains({b},{a}) or {both})"


def _sql(fields: dict, keep: str = "") -> str:
    return "(select * from (select " + ", ".join(f"{e} as {k}" for k, e in fields.items()) + f" from orders){keep})"


def _cascade(keep: str = "") -> str:
    """CTEs e0, s0, e, ps, r (one row a turn), m (one row an entry, with its status)."""
    free = "not list_contains(used, x.i)"
    money = "regexp_replace({0},'[$,]','','g')::decimal(18,2)"
    differs = [
        ("Instrument Number", f"{_letters('e0.number')}<>'' and {_letters('s0.number')}<>'' and {_letters('e0.number')}<>{_letters('s0.number')}"),
        ("Book/Page", f"{_letters('e0.book_page')}<>'' and {_letters('s0.book_page')}<>'' and {_letters('e0.book_page')}<>{_letters('s0.book_page')}"),
        ("Document Date", f"{_date('e0.documented')}<>{_date('s0.documented')}"),
        ("Recording Date", f"{_date('e0.recorded')}<>{_date('s0.recorded')}"),
        ("Amount", f"coalesce({money.format('e0.amount')}<>{money.format('s0.amount')},false)"),
        ("Parties", "coalesce(case e0.parties when 'ACME Bank of Ohio' then (coalesce(s0.p1 is not null,false)::int*2+coalesce(s0.p2 is not null,false)::int)<2 when 'Smith, John' then s0.p2 is null when 'to' then s0.p1 is null and s0.p2 is null end,false)"),
        ("Legal Description", f"{_legal('e0.legal')}<>{_legal('s0.legal')}"),
    ]
    listed = ",".join(f"case when {test} then '{name}' end" for name, test in differs)
    return f"""e0 as {_sql(_ENTRY, keep)}, s0 as {_sql(_SOURCE)},
 e as (select packet, entry, row_number() over (partition by packet order by ord, entry) i, {_letters('number')} n, {_letters('book_page')} b, {_words('kind')} k, e1 is not null ev from e0),
 ps as (select packet, list({{'i': i, 'source': source, 'n': n, 'b': b, 'k': k, 'ev': ev}} order by i) ss from (select packet, source, row_number() over (partition by packet order by pos, source) i, {_letters('number')} n, {_letters('book_page')} b, {_words('kind')} k, e1 is not null ev from s0) group by packet),
 r as (select packet, 0::bigint i, null::bigint entry, []::bigint[] used, null::bigint source, null::int tier from ps
   union all select packet, i, entry, case when pick is not null and pick.ev and ev then list_append(used, pick.i) else used end, pick.source, case when pick is null then null when one is not null then 1 when two is not null then 2 else 3 end
   from (select *, coalesce(one, two, case when len(fit)=1 then fit[1] end) pick from (select r.packet, e.i, e.entry, e.ev, r.used,
     list_filter(ss, lambda x: {free} and e.n<>'' and x.n=e.n)[1] one, list_filter(ss, lambda x: {free} and e.b<>'' and x.b=e.b and {_fit('e.k', 'x.k')})[1] two, list_filter(ss, lambda x: {free} and {_fit('e.k', 'x.k')}) fit
     from r join e on e.packet=r.packet and e.i=r.i+1 join ps on ps.packet=r.packet))),
 m as (select e0.packet, e0.entry, r.source, r.tier, case when s0.source is null or e0.e1 is null or s0.e1 is null then 'SOURCE_MISSING' end missing, list_filter([{listed}], lambda x: x is not null) fields, list_filter([e0.e1, s0.e1], lambda x: x is not null) evidence
   from e0 left join r on r.packet=e0.packet and r.entry=e0.entry left join s0 on s0.packet=e0.packet and s0.source=r.source),
 f as (select packet, entry, source, tier, coalesce(missing, case when len(fields)>0 then 'MISMATCH' else 'MATCH' end) status, case when missing is null then array_to_string(fields,'; ') else '' end fields, array_to_string(evidence,',') evidence from m)"""


_LOST = f"""lost as (select r.packet, r.reference from {_sql(_REFERENCE)} r where not exists (select 1 from s0 where s0.packet=r.packet and case when {_letters('r.number')}<>'' then {_letters('r.number')}={_letters('s0.number')} when {_letters('r.book_page')}<>'' then {_letters('r.book_page')}={_letters('s0.book_page')}
   else {_fit(_words('r.kind'), _words('s0.kind'))} and len(list_filter(string_split({_words('r.description')},' '), lambda w: len(w)>3 and contains({_words('s0.kind')},w)))>0 end))"""
_LEFT = "omit as (select packet, source from s0 where regexp_matches(kind,'(?i)deed|mortgage|assignment|release|satisfaction|reconveyance|judgment|lien|trustee|foreclosure') and not regexp_matches(kind,'(?i)assessor|tax bill|pacer|bankrupt') and not exists (select 1 from f where f.packet=s0.packet and f.source=s0.source))"
_COUNTS = f"""c as (select packet, count(*) n, count(*) filter (status='MATCH') matched, count(*) filter (status='MISMATCH') mismatched, count(*) filter (status='SOURCE_MISSING') source_missing from f group by packet),
 o as (select packet, count(*) omitted from omit group by packet), {_LOST}, l as (select packet, count(*) unavailable from lost group by packet)"""
_TEXT = "coalesce(n,0)||(case when coalesce(n,0)=1 then ' entry; ' else ' entries; ' end)||coalesce(matched,0)||' matched, '||coalesce(mismatched,0)||' mismatched, '||coalesce(source_missing,0)||' missing source; '||coalesce(omitted,0)||' material source instrument(s) omitted; '||coalesce(unavailable,0)||' referenced source document(s) unavailable.'"
_ZERO = ", ".join(f"case when detected then coalesce({c},0) else 0 end {c}" for c in ("n", "matched", "mismatched", "source_missing", "omitted", "unavailable"))
_JOINS = "from customer left join c on c.packet=c_custkey left join o on o.packet=c_custkey left join l on l.packet=c_custkey"

ORACLES = {
    "reconcile_greedy": """with recursive l as (select l_orderkey, sum(l_extendedprice::decimal(18,2)) amount from lineitem group by 1),
 e as (select o_custkey packet, o_orderkey entry, amount, row_number() over (partition by o_custkey order by o_orderkey) i from l join orders on l_orderkey=o_orderkey),
 s as (select o_custkey packet, list({'source': o_orderkey, 'amount': o_totalprice::decimal(18,2)} order by o_orderkey) ss from orders group by 1),
 r as (select packet, 0::bigint i, null::bigint entry, []::bigint[] used, null::bigint source from s
   union all select packet, i, entry, case when pick is null then used else list_append(used, pick.source) end, pick.source
   from (select r.packet, e.i, e.entry, r.used, list_sort(list_transform(list_filter(ss, lambda x: not list_contains(used, x.source) and abs(x.amount-e.amount)*4<=abs(e.amount)), lambda x: {'off': abs(x.amount-e.amount), 'source': x.source}))[1] pick from r join e on e.packet=r.packet and e.i=r.i+1 join s on s.packet=r.packet))
 select packet, entry, source from r where entry is not null""",
    "reconcile_cascade": f"with recursive {_cascade()} select * from f",
    "reconcile_packets": f"with recursive {_cascade()}, {_LEFT}, {_COUNTS}, w as (select c_custkey packet, c_custkey%10>0 detected, n, matched, mismatched, source_missing, omitted, unavailable {_JOINS}) select packet, detected, {_ZERO}, case when detected then 'Title summary: '||{_TEXT} else 'Opening title summary was not confidently segmented; title-report-to-source reconciliation cannot be completed.' end summary from w",
    "reconcile_run_sheet": f"""with recursive {_cascade(" where kind <> ''")}, {_LEFT}, {_COUNTS} select c_custkey packet, case when c_custkey%3=0 then 'Run Sheet: '||{_TEXT} else 'No distinct Run Sheet or Abstractor Sheet was supplied; Run Sheet reconciliation is not applicable.' end summary {_JOINS}""",
    "unavailable_references": f"with s0 as {_sql(_SOURCE)}, {_LOST} select * from lost",
}
