"""Queries of evidence anchors over nested extractions made from documents, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import anchors

#: In SQL that both engines read.
_ROW = {
    "packet": "doc_id % 60", "page": "cast(doc_id as int)", "kind": "case doc_id % 3 when 0 then 'Deed' when 1 then 'deed ' end", "number": "case when doc_id % 4 = 0 then concat('No. ', cast(doc_id % 9 as string)) end",
    "quote": "case when doc_id % 7 = 0 then ' ' when doc_id % 7 = 1 then 'these words are on no page at all' when doc_id % 7 = 2 then concat(substr(text, 5, 60), ' zzqx') else substr(text, 20, 50) end",
    "confidence": "case when doc_id % 5 > 0 then cast(doc_id % 5 as double) / 3 end",
}


def _raw(spark, d):
    """header.owner.evidence, instruments[].evidence, instruments[].parties[].evidence, and a field without anchors."""
    rows = spark.read.parquet(f"{d}/documents.parquet").selectExpr(*[f"{e} as {k}" for k, e in _ROW.items()])
    anchor = F.struct("page", "kind", "number", "quote", "confidence")
    other = F.struct((F.col("page") - 1).alias("page"), F.upper("kind").alias("kind"), F.col("number"), F.col("quote"), F.lit(0.9).alias("confidence"))
    party = F.struct(F.lit("Jo").alias("name"), F.array(other, anchor).alias("evidence"))
    instrument = F.struct("page", F.when(F.col("page") % 2 == 0, F.array(anchor)).alias("evidence"), F.array(party).alias("parties"))
    packed = rows.groupBy("packet").agg(F.array_sort(F.collect_list(instrument)).alias("instruments"), F.min_by(anchor, "page").alias("first"))
    owner = F.struct(F.lit("Jo").alias("value"), F.array("first").alias("evidence"))
    return packed.select("packet", F.struct(F.struct(F.when(F.col("packet") % 3 > 0, owner).alias("owner")).alias("header"), "instruments", F.array(F.lit("note")).alias("notes")).alias("raw"))


def _pages(spark, d):
    i = F.col("doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").select((i % 60).alias("packet"), i.cast("int").alias("page"), "text", F.when(i % 4 == 0, "tesseract").when(i % 4 == 1, "native").alias("source"), (i % 11 == 0).alias("unseen"))


def anchors_collected(spark, d):
    out = anchors.collected(_raw(spark, d))
    return out.select("packet", F.col("seq").cast("long").alias("seq"), "path", "anchor.page", F.sha2(F.coalesce("anchor.quote", F.lit("")), 256).alias("quote"))


def anchor_ledger(spark, d):
    out = anchors.verified(anchors.ledger(anchors.collected(_raw(spark, d))), _pages(spark, d))
    return out.select("packet", "id", "page", "kind", "number", F.round("confidence", 4).alias("confidence"), "places", "text_verified", "source", "native")


def anchors_in_place(spark, d):
    rows = anchors.with_ids(_raw(spark, d)).select("packet", "raw.header", F.posexplode("raw.instruments").alias("i", "x"))
    join = lambda c: F.array_join(c, ",")
    return rows.select("packet", F.col("i").cast("long").alias("i"), join(F.coalesce("header.owner.evidence_ids", F.array().cast("array<string>"))).alias("owner"), join("x.evidence_ids").alias("ids"), join(F.col("x.parties")[0]["evidence_ids"]).alias("party"))


QUERIES = {f.__name__: f for f in (anchors_collected, anchor_ledger, anchors_in_place)}


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x},'')),'[“”‘’]','''','g'),'[^a-z0-9$#./''-]+',' ','g'))"


_ID = f"'ev_'||substr(sha256(packet||'|'||page||'|'||{_norm('kind')}||'|'||{_norm('number')}||'|'||{_norm('quote')}),1,20)"
_BASE = f"""t as (select {', '.join(f'{e} as {k}' for k, e in _ROW.items())} from documents), n as (select *, row_number() over (partition by packet order by page) - 1 i from t),
 a as (select packet, page, kind, number, quote, confidence, 0 i, 0 g, 0 k, 'header.owner.evidence[0]' path from n where i=0 and packet%3>0
  union all select packet, page, kind, number, quote, confidence, i, 1, 0, 'instruments['||i||'].evidence[0]' from n where page%2=0
  union all select packet, page-1, upper(kind), number, quote, 0.9, i, 2, 0, 'instruments['||i||'].parties[0].evidence[0]' from n
  union all select packet, page, kind, number, quote, confidence, i, 2, 1, 'instruments['||i||'].parties[0].evidence[1]' from n),
 s as (select *, row_number() over (partition by packet order by g>0, i, g, k) - 1 seq, {_ID} id, trim(quote)<>'' and page>=1 ok from a)"""
_TOKENS = f"list_filter(string_split({_norm('l.quote')},' '), lambda t: len(t)>1)"
ORACLES = {
    "anchors_collected": f"with {_BASE} select packet, seq, path, page, sha256(coalesce(quote,'')) quote from s",
    "anchor_ledger": f"""with {_BASE}, l as (select packet, id, any_value(page) page, trim(arg_min(quote, seq)) quote, arg_min({{'k': kind, 'n': number, 'c': confidence}}, seq) x, count(*) places from s where ok group by 1,2),
 v as (select l.*, d.doc_id%4 m, coalesce(doc_id%11>0 and (contains({_norm('d.text')},{_norm('l.quote')}) or (len({_TOKENS})>=4 and len(list_filter({_TOKENS}, lambda t: list_contains(string_split({_norm('d.text')},' '),t)))>=0.82*len({_TOKENS}))), false) yes from l left join documents d on d.doc_id%60=l.packet and d.doc_id=l.page)
 select packet, id, page, case when coalesce(trim(x.k),'')='' then 'Unclassified' else trim(x.k) end kind, x.n number, round(case when x.c is null then 0.5 else least(1,x.c) end,4) confidence, places, yes text_verified, case when yes then (case when m=0 then 'tesseract' else 'native' end) end source, yes and m>0 native from v""",
    "anchors_in_place": f"""with {_BASE} select n.packet, n.i, coalesce((select string_agg(id, ',') from s where s.packet=n.packet and g=0 and ok),'') owner, coalesce((select id from s where s.packet=n.packet and s.i=n.i and g=1 and ok),'') ids, coalesce((select string_agg(id, ',' order by k) from s where s.packet=n.packet and s.i=n.i and g=2 and ok),'') party from n""",
}
