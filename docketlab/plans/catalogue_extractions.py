"""Queries of merged extractions over order lines as what several extractions say, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import extractions as X

_POS = "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey"
#: In SQL that both engines read; lists (parties, refs, evidence) are built apart.
_ROW = {
    "packet": "l_suppkey", "pos": _POS,
    "number": "case l_orderkey % 5 when 0 then 'n/a' when 1 then 'Unknown' when 2 then concat('Inst. ', cast(l_orderkey % 23 as string)) when 3 then concat('INST ', cast(l_orderkey % 23 as string)) end",
    "book_page": "case when l_partkey % 3 = 0 then concat('Book ', cast(l_partkey % 7 as string)) when l_partkey % 3 = 1 then 'Needs review' end",
    "kind": "case l_linenumber when 1 then 'Deed' when 2 then 'deed.' when 3 then 'Deed of Trust' when 4 then '' else 'DEED' end",
    "documented": "case when l_linenumber < 4 then substr(cast(l_shipdate as string), 1, 7) end",
    "recorded": "case when l_linenumber % 2 = 0 then substr(cast(l_shipdate as string), 1, 4) else 'Not stated' end",
    "amount": "concat('$', cast(cast(l_quantity as int) % 9 as string))", "status": "case l_returnflag when 'N' then 'not provided' when 'A' then 'Open' else 'open!' end",
    "address": "case when l_partkey % 4 = 0 then 'Oak St' when l_partkey % 4 = 1 then 'OAK  ST' end", "legal": "cast(null as string)",
    "category": "case when l_partkey % 2 = 0 then 'Deeds' else 'deeds ' end", "description": "case when l_partkey % 5 > 0 then concat('ref ', cast(l_partkey % 5 as string)) end",
    "p1": "case l_partkey % 4 when 0 then 'Jo Smith' when 1 then 'JO SMITH' when 2 then 'Ann Lee' else '' end", "r1": "case l_linenumber when 1 then 'Grantor' when 2 then 'grantor' else 'Grantee' end",
    "ref1": "case when l_partkey % 6 < 4 then concat('R', cast(l_partkey % 6 as string)) when l_partkey % 6 = 4 then 'unknown' end",
    "e_page": "cast(l_partkey % 4 as int)", "e_quote": "case when l_partkey % 8 < 4 then 'Quoted, text' else 'quoted text' end", "e_conf": "cast(l_linenumber as double) / 8", "e_has": "l_partkey % 9 > 0",
}


def _rows(spark, d):
    out = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*[f"{e} as {k}" for k, e in _ROW.items()])
    anchor = F.struct(F.col("e_page").alias("page"), F.col("kind").alias("kind"), F.lit(None).cast("string").alias("number"), F.col("e_quote").alias("quote"), F.col("e_conf").alias("confidence"))
    none = F.array().cast(f"array<{X.ANCHOR}>")
    return out.withColumns({"parties": F.array(F.struct(F.col("p1").alias("name"), F.col("r1").alias("role"))), "refs": F.array("ref1", F.lit("R0")), "evidence": F.when(F.col("e_has"), F.array(anchor)).otherwise(none)})


def _anchors(evidence):
    return F.array_join(F.transform(evidence, lambda a: F.concat_ws(":", a["page"].cast("string"), a["kind"], a["quote"], F.format_number(a["confidence"], 3))), ";")


def instruments_merged(spark, d):
    out = X.merge_instruments(_rows(spark, d))
    parties = F.array_join(F.transform("parties", lambda p: F.concat_ws("=", p["role"], p["name"])), ";")
    return out.select("packet", "key", *X.FIELDS, "n", parties.alias("parties"), F.array_join("refs", ",").alias("refs"), _anchors(F.col("evidence")).alias("evidence"))


def entries_merged(spark, d):
    rows = _rows(spark, d).withColumn("parties", F.col("p1"))
    return X.merge_entries(rows).select("packet", "key", "n", *X.ENTRY_FIELDS, _anchors(F.col("evidence")).alias("evidence"))


def references_merged(spark, d):
    return X.merge_references(_rows(spark, d)).select("packet", "key", "pos", "kind", "number", "book_page", "description", _anchors(F.col("evidence")).alias("evidence"))


def summary_bounds(spark, d):
    parts = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("packet"), (F.col("o_orderkey") % 3 == 0).alias("detected"), (F.col("o_orderkey") % 5).alias("page_start"), (F.col("o_orderkey") % 7 + 2).alias("page_end"))
    return X.summary_bounds(parts)


QUERIES = {f.__name__: f for f in (instruments_merged, entries_merged, references_merged, summary_bounds)}


def _norm(x: str) -> str:
    return f"trim(regexp_replace(upper(coalesce({x},'')),'[^A-Z0-9]+',' ','g'))"


def _missing(x: str) -> str:
    return f"({_norm(x)} in ('','NOT STATED','NEEDS REVIEW','UNKNOWN','NOT PROVIDED','N A','NA'))"


_T = f"t as (select *, case when e_has and e_page>0 then e_page else 0 end first_page from (select {', '.join(f'{e} as {k}' for k, e in _ROW.items())} from lineitem))"
_KEY = f"case when not {_missing('number')} then 'NUM:'||{_norm('number')} when not {_missing('book_page')} then 'BOOK:'||{_norm('kind')}||':'||{_norm('book_page')} else 'PAGE:'||{_norm('kind')}||':'||first_page||':'||{_norm('documented')} end"
_EKEY = f"case when not {_missing('number')} then 'NUM:'||{_norm('number')}||':'||{_norm('category')} else {_norm('category')}||'|'||{_norm('kind')}||'|'||{_norm('book_page')}||'|'||case when e_has then e_page else 0 end end"
_RKEY = f"{_norm('kind')}||'|'||{_norm('number')}||'|'||{_norm('book_page')}||'|'||{_norm('description')}"


def _anchor_sql(key: str) -> str:
    form = f"e_page||'|'||{_norm('kind')}||'|'||{_norm('e_quote')}"
    return f"""(select packet, key, string_agg(e_page||':'||kind||':'||e_quote||':'||printf('%.3f', e_conf), ';' order by e_page, e_conf desc, pos) evidence
   from (select packet, {key} key, pos, e_page, kind, e_quote, e_conf from t where e_has qualify row_number() over (partition by packet, {key}, {form} order by pos)=1) group by 1,2)"""


def _vote(f: str) -> str:
    return f"""v_{f} as (select packet, key, value from (select packet, key, arg_min({f}, pos) value, count(*) n, min(pos) p from k where not {_missing(f)} group by packet, key, {_norm(f)}) qualify row_number() over (partition by packet, key order by n desc, length(value) desc, p)=1)"""


def _fold(f: str) -> str:
    """The last of the values that took over, found by walking the key's rows in order."""
    usable = f"list_filter(rows, lambda x: not {_missing('x.' + f)})"
    walk = f"list_reduce(list_transform({usable}, lambda x: x.{f}), lambda a, b: case when {_norm('a')}<>{_norm('b')} and length(b)>length(a) then b else a end)"
    return f"case when n=1 then rows[1].{f} when len({usable})=0 then 'Not Stated' else {walk} end {f}"


_E_FIELDS = ["category", "kind", "number", "book_page", "documented", "recorded", "amount", "p1", "legal"]
ORACLES = {
    "instruments_merged": f"with {_T}, k as (select *, {_KEY} key from t), "
    + ", ".join(_vote(f) for f in X.FIELDS)
    + f""", g as (select packet, key, count(*) n from k group by 1,2),
 p as (select packet, key, string_agg(r1||'='||p1, ';' order by pos) parties from (select packet, key, r1, p1, pos from k qualify row_number() over (partition by packet, key, {_norm('r1')}, {_norm('p1')} order by pos)=1) group by 1,2),
 r as (select packet, key, string_agg(ref, ',' order by pos, i) refs from (select packet, key, ref, pos, i from (select packet, key, pos, unnest([ref1,'R0']) ref, unnest([0,1]) i from k) where not {_missing('ref')} qualify row_number() over (partition by packet, key, ref order by pos, i)=1) group by 1,2)
 select g.packet, g.key, {', '.join(f"coalesce(v_{f}.value,'Not Stated') {f}" for f in X.FIELDS)}, g.n, coalesce(parties,'') parties, coalesce(refs,'') refs, coalesce(evidence,'') evidence from g """
    + " ".join(f"left join v_{f} on v_{f}.packet=g.packet and v_{f}.key=g.key" for f in X.FIELDS)
    + f" left join p on p.packet=g.packet and p.key=g.key left join r on r.packet=g.packet and r.key=g.key left join {_anchor_sql(_KEY)} a on a.packet=g.packet and a.key=g.key",
    "entries_merged": f"with {_T}, g as (select packet, {_EKEY} key, count(*) n, list({{{', '.join(repr(f) + ': ' + f for f in _E_FIELDS)}}} order by pos) rows from t group by 1,2)"
    f" select g.packet, g.key, n, {', '.join(_fold(f).removesuffix(' p1') + ' parties' if f == 'p1' else _fold(f) for f in _E_FIELDS)}, coalesce(evidence,'') evidence from g left join {_anchor_sql(_EKEY)} a on a.packet=g.packet and a.key=g.key",
    "references_merged": f"with {_T}, g as (select packet, {_RKEY} key, min(pos) pos, arg_min({{'k': kind, 'n': number, 'b': book_page, 'd': description}}, pos) f from t group by 1,2) select g.packet, g.key, pos, f.k kind, f.n number, f.b book_page, f.d description, coalesce(evidence,'') evidence from g left join {_anchor_sql(_RKEY)} a on a.packet=g.packet and a.key=g.key",
    "summary_bounds": "select o_custkey packet, bool_or(o_orderkey%3=0) detected, coalesce(min(o_orderkey%5) filter (o_orderkey%3=0 and o_orderkey%5>0),0) page_start, coalesce(max(o_orderkey%7+2) filter (o_orderkey%3=0),0) page_end from orders group by 1",
}
