"""Queries of the evidence graph over customers as packets and their orders as instruments, references and report
entries, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import evidence_graph as G
from docketlab.operators import review

#: In SQL that both engines read, by table; lists of evidence are built of e1 and e2.
_TABLES = {
    "packets": ("customer", {"packet": "c_custkey", "hash": "concat('h', cast(c_custkey * 1000003 as string), '000000000000000000000000000000')", "file": "c_name", "review": "concat('r', cast(c_custkey % 9 as string))", "state": "cast(c_nationkey as string)", "county": "c_mktsegment", "parcel": "cast(c_custkey % 3 as string)", "address": "concat(c_name, ' Oak Street')", "e1": "case when c_custkey % 2 = 0 then 'e1' end", "e2": "''"}),
    "instruments": ("orders", {"packet": "o_custkey", "instrument": "cast(o_orderkey as string)", "pos": "o_orderkey % 7", "kind": "case o_orderkey % 3 when 0 then 'Deed of Trust' when 1 then 'Assignment' else 'Judgment Lien' end", "number": "case when o_orderkey % 8 = 0 then ' - ' when o_orderkey % 8 = 1 then '' else concat('No. ', cast(o_orderkey % 12 as string)) end", "status": "o_orderstatus", "e1": "concat('e', cast(o_orderkey % 6 as string))", "e2": "case when o_orderkey % 4 = 0 then 'e0' end"}),
    "parties": ("orders", {"packet": "o_custkey", "instrument": "cast(o_orderkey as string)", "pos": "o_orderkey", "name": "case o_orderkey % 5 when 0 then 'ACME Bank' when 1 then 'Acme  bank.' when 2 then 'Jo Smith' else o_orderpriority end", "role": "case o_orderkey % 4 when 0 then 'Assignor' when 1 then 'assignee of record' when 2 then 'Trustee' else '' end", "e1": "concat('p', cast(o_orderkey % 3 as string))", "e2": "''"}),
    "references": ("orders", {"packet": "o_custkey", "instrument": "cast(o_orderkey as string)", "reference": "case when o_orderkey % 9 = 0 then '--' else concat('no ', cast((o_orderkey * 5) % 17 as string)) end"}),
    "entries": ("orders", {"packet": "o_custkey", "entry": "concat('r', cast(o_orderkey % 31 as string))", "pos": "o_orderkey", "category": "o_orderpriority", "kind": "case when o_orderkey % 3 > 0 then 'Mortgage' else '' end", "number": "case when o_orderkey % 5 = 0 then '' else concat('NO ', cast((o_orderkey + 1) % 15 as string)) end", "e1": "case when o_orderkey % 4 > 0 then concat('e', cast(o_orderkey % 5 as string)) end", "e2": "'x'"}),
    "evidence": ("(select distinct o_custkey, o_orderkey % 4 k from orders)", {"packet": "o_custkey", "evidence": "concat('e', cast(k as string))", "page": "k + 1", "kind": "case when k % 2 = 0 then 'Deed' else 'Plat' end"}),
    "checks": ("(select distinct o_custkey, o_orderkey % 26 k from orders)", {"packet": "o_custkey", "check_id": "concat('CHECK_', cast(k as string))", "question": "case when k < 20 then k + 1 end", "label": "concat('Check number ', cast(k as string))", "status": "case when k % 3 = 0 then 'FAIL' else 'PASS' end", "e1": "concat('e', cast(k % 6 as string))", "e2": "''"}),
}
_ORDERS_A_TASK = 50_000
_TARGETS = {"packet": "c_custkey", "target": "case when c_custkey % 3 > 0 then cast(c_custkey % 500 as string) end", "e1": "'t'", "e2": "'e1'"}


def _select(fields: dict) -> str:
    return ", ".join(f"{e} as {k}" for k, e in fields.items())


def _frame(spark, sql, fields):
    out = spark.sql(f"select {_select(fields)} from {sql[0]}", **sql[1])
    return out.withColumn("evidence", F.array("e1", "e2")).drop("e1", "e2") if "e1" in fields else out


def _tables(spark, d):
    # rows of a packet come together once, before texts and ids are made of them; an order makes some 12 rows, so tasks
    # are counted by orders, and a number given keeps them from being put together by their small size
    read = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "orders")}
    parts = max(spark.sparkContext.defaultParallelism, read["orders"].count() // _ORDERS_A_TASK + 1)
    read = {n: df.repartition(parts, {"customer": "c_custkey", "orders": "o_custkey"}[n]) for n, df in read.items()}
    at = lambda text: (text.replace("customer", "{customer}").replace("orders", "{orders}"), {n: f for n, f in read.items() if n in text})
    t = {name: _frame(spark, at(source), fields) for name, (source, fields) in _TABLES.items()}
    return t, _frame(spark, at("customer"), _TARGETS)


def title_graph_nodes(spark, d):
    attributes = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null")))), ";")
    return G.nodes(_tables(spark, d)[0]).select("packet", "id", "type", "label", attributes.alias("attributes"), F.array_join("evidence", ",").alias("evidence"))


def title_graph_edges(spark, d):
    t, targets = _tables(spark, d)
    return G.edges(t, targets).withColumn("evidence", F.array_join("evidence", ","))


def reference_resolution(spark, d):
    t, _ = _tables(spark, d)
    return G.resolved_references(t["instruments"], t["references"]).select("packet", "instrument", "reference", "target", "external")


def _relevant(spark, d):
    t, targets = _tables(spark, d)
    words = ["acme bank deed", "which assignment or judgment", "plat check fail", "mortgage number trust", "street property nothing", "zzz"]
    asked = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("c_custkey") % len(words) + 1).cast("int"))
    q = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("question"), F.col("c_custkey").alias("packet"), review.question_tokens(asked).alias("tokens"))
    return G.relevant(q, G.nodes(t), G.edges(t, targets))


def relevant_graph_nodes(spark, d):
    return _relevant(spark, d)[0].select("question", "id", "place")


def relevant_graph_edges(spark, d):
    return _relevant(spark, d)[1].select("question", "id", "place")


QUERIES = {f.__name__: f for f in (title_graph_nodes, title_graph_edges, reference_resolution, relevant_graph_nodes, relevant_graph_edges)}


def _sql_table(name: str, source: str, fields: dict) -> str:
    lists = ", list_sort(list_distinct(list_filter([e1, e2], lambda x: x is not null and x<>''))) ev" if "e1" in fields else ""
    return f"t_{name} as (select *{lists} from (select {_select(fields)} from {source}))"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(upper({x}),'[^A-Z0-9]+',' ','g'))"


def _hash(prefix: str, x: str) -> str:
    return f"'{prefix}'||substr(sha256({x}),1,20)"


_BASE = ", ".join(_sql_table(n, s, f) for n, (s, f) in _TABLES.items()) + ", " + _sql_table("targets", "customer", _TARGETS) + f""",
 key as (select packet, 'packet_'||substr(hash,1,24) pn, {_hash('property_', f"{_norm('state')}||'|'||{_norm('county')}||'|'||{_norm('parcel')}||'|'||{_norm('address')}")} en from t_packets),
 idx as (select packet, {_norm('number')} norm, arg_max('instrument_'||instrument, (pos, instrument)) target from t_instruments where {_norm('number')}<>'' group by 1,2),
 ref as (select r.packet, r.instrument, r.reference, coalesce(idx.target, {_hash('external_', _norm('r.reference'))}) target, idx.target is null external, i.ev from t_references r join t_instruments i using (packet, instrument) left join idx on idx.packet=r.packet and idx.norm={_norm('r.reference')} where {_norm('r.reference')}<>'')"""
_UNION = "list_sort(list_distinct(flatten(list(ev))))"
_FIRST = "arg_min({0}, (turn, pos, label))"
_NODES = f"""raw as (
 select packet, 0 turn, 0::bigint pos, pn id, 'PACKET' as "type", file label, 'packetHash='||hash||';reviewId='||review attributes, []::varchar[] ev from t_packets join key using (packet)
 union all select packet, 0, 0, en, 'PROPERTY', address, 'parcelId='||parcel||';state='||state||';county='||county, ev from t_packets join key using (packet)
 union all select packet, 1, pos, 'instrument_'||instrument, 'INSTRUMENT', kind||case when number<>'' then ' · '||number else '' end, 'instrumentId='||instrument||';instrumentType='||kind||';instrumentNumber='||number||';status='||status, ev from t_instruments
 union all select packet, 1, pos, {_hash('party_', _norm('name'))}, 'PARTY', name, 'name='||name, ev from t_parties
 union all select packet, 2, 0, target, 'EXTERNAL_REFERENCE', reference, 'instrumentNumber='||reference, ev from ref where external
 union all select packet, 3, pos, {_hash('report_entry_', 'entry')}, 'REPORT_ENTRY', (case when kind<>'' then kind else category end)||' · '||(case when number<>'' then number else 'unidentified' end), 'category='||category||';instrumentType='||kind||';instrumentNumber='||number, ev from t_entries
 union all select packet, 4, 0, 'evidence_'||evidence, 'EVIDENCE', 'Page '||page||' · '||kind, 'page='||page||';documentType='||kind, [evidence] from t_evidence
 union all select packet, 5, 0, {_hash('check_', 'check_id')}, 'CHECK', (case when question is not null then 'Q'||question||' · ' else '' end)||label, 'checkId='||check_id||';status='||status, ev from t_checks),
 n as (select packet, id, {_FIRST.format('"type"')} as "type", {_FIRST.format('label')} label, arg_max(attributes, (turn, pos, label)) attributes, array_to_string({_UNION},',') evidence from raw group by packet, id)"""
_EDGES = f"""known as (select packet, evidence one from t_evidence),
 links as (
 select packet, pn src, en dst, 'CONTAINS' as "type", 'packet property' label, ev from t_packets join key using (packet)
 union all select packet, pn, 'instrument_'||instrument, 'CONTAINS', 'packet instrument', ev from t_instruments join key using (packet)
 union all select packet, 'instrument_'||instrument, en, 'AFFECTS_PROPERTY', 'affects property', ev from t_instruments join key using (packet)
 union all select p.packet, 'instrument_'||p.instrument, {_hash('party_', _norm('p.name'))}, case when upper(role) like '%ASSIGNOR%' then 'ASSIGNOR' when upper(role) like '%ASSIGNEE%' then 'ASSIGNEE' else 'HAS_PARTY' end, case when role='' then 'party' else role end, list_concat(i.ev, p.ev) from t_parties p join t_instruments i using (packet, instrument)
 union all select packet, 'instrument_'||instrument, target, 'REFERENCES', 'references '||reference, ev from ref
 union all select packet, pn, {_hash('report_entry_', 'entry')}, 'CONTAINS', 'title report entry', ev from t_entries join key using (packet)
 union all select e.packet, {_hash('report_entry_', 'entry')}, coalesce(target, en), case when target is null then 'REPORTS_UNRESOLVED' else 'REPORTS_INSTRUMENT' end, case when target is null then 'report entry lacks matched supplied instrument' else 'report/source match candidate' end, ev from t_entries e join key using (packet) left join idx on idx.packet=e.packet and idx.norm={_norm('e.number')}
 union all select packet, 'instrument_'||instrument, 'evidence_'||one, 'SUPPORTED_BY', 'instrument evidence', [one] from (select packet, instrument, unnest(ev) one from t_instruments) semi join known using (packet, one)
 union all select packet, pn, {_hash('check_', 'check_id')}, 'CONTAINS', 'review check', ev from t_checks join key using (packet)
 union all select packet, {_hash('check_', 'check_id')}, 'evidence_'||one, 'CHECK_SUPPORTED_BY', 'check evidence', [one] from (select packet, check_id, unnest(ev) one from t_checks) semi join known using (packet, one)
 union all select packet, en, 'instrument_'||target, 'TARGET_LIEN', 'selected target lien', ev from t_targets join key using (packet) where exists (select 1 from t_instruments i where i.packet=t_targets.packet and i.instrument=t_targets.target)),
 g as (select packet, {_hash('edge_', "src||'|'||dst||'|'||\"type\"||'|'||label")} id, src, dst, "type", label, array_to_string({_UNION},',') evidence from links group by packet, src, dst, "type", label)"""
#: The loop over edges as a recursion: each step adds an end while there is room.
_RELEVANT = f"""with recursive {_BASE}, {_NODES}, {_EDGES},
 q as (select c_custkey question, case c_custkey%6 when 0 then ['acme','bank','deed'] when 1 then ['which','assignment','judgment'] when 2 then ['plat','check','fail'] when 3 then ['mortgage','number','trust'] when 4 then ['street','property','nothing'] else ['zzz'] end toks from customer),
 w as (select question, id, list_sum(list_transform(toks, lambda t: case when contains(trim(regexp_replace(lower("type"||' '||label||' '||attributes),'[^a-z0-9$#./''-]+',' ','g')),t) then (case when len(t)>7 then 2 else 1 end) else 0 end)) score from q join n on n.packet=q.question),
 seeds as (select question, id, place from (select *, row_number() over (partition by question order by score desc, id) place from w where score>0) where place<=16),
 near as (select question, id, src, dst, place from (select q.question, g.id, src, dst, row_number() over (partition by q.question order by g.id) place from q join g on g.packet=q.question where exists (select 1 from seeds s where s.question=q.question and s.id in (g.src, g.dst))) where place<=48),
 ends as (select question, unnest([src,dst]) id, place*2+unnest([0,1]) step from near),
 ord as (select *, row_number() over (partition by question order by step) i from ends),
 r as (select question, 0::bigint i, list(id order by place) picked from seeds group by question
   union all select r.question, ord.i, case when len(picked)<28 and not list_contains(picked, ord.id) then list_append(picked, ord.id) else picked end from r join ord on ord.question=r.question and ord.i=r.i+1),
 last as (select question, arg_max(picked, i) picked from r group by question)"""

ORACLES = {
    "title_graph_nodes": f"with {_BASE}, {_NODES} select * from n",
    "title_graph_edges": f"with {_BASE}, {_EDGES} select * from g",
    "reference_resolution": f"with {_BASE} select packet, instrument, reference, target, external from ref",
    "relevant_graph_nodes": f"{_RELEVANT} select question, unnest(picked) id, generate_subscripts(picked,1) place from last",
    "relevant_graph_edges": f"{_RELEVANT} select question, id, place from near",
}
