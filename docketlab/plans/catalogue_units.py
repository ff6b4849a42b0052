"""Queries of the smaller operators that others are made of, over rows of the given tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.functions import text as T
from docketlab.operators import cascade, checks, liens, merge, reconcile, retrieval, review
from docketlab.sources import packets


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values: list[str | None], i: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(i) % len(values) + 1).cast("int"))


STATUSES = ["Open", "Released", "unreleased", "Paid in full", "unpaid", "affects title", "satisfied of record", "see note", "", None, "Unsatisfied", "ACTIVE", "Cancelled"]
KINDS = ["Deed of Trust", "Mortgage", "Security Deed", "Assignment of Deed", "Release", "Satisfaction", "Judgment", "Lien", "Foreclosure Notice", "Trustee", "Deed", "Plat", "Survey", "Other", "Needs review", "", None]
DATES = ["1/2/95", "12-31-2020", "2020-03-04", "March 5, 2020", "Mar 5, 2020", "5 March 2020", "no date", "Needs review", None, "recorded 3/4/2021 here"]
LEGALS = ["The Lot 1 of the Oak Block", "LOT 1 OF OAK BLOCK", "Lot-1, of Oak Block!", "Needs review", None, "theory of the lot"]
MESSAGES = ["Error 429: slow down", "insufficient_quota", "rate limit reached", "HTTP 500", None, "code 14290"]


def lien_statuses(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", liens.lien_status(_pick(STATUSES, "o_orderkey"), F.col("o_orderkey") % 17 == 0, F.col("o_custkey") % 4 == 0).alias("status"))


def type_pairs(spark, d):
    p = _t(spark, d, "part").withColumns({"a": _pick(KINDS, "p_partkey"), "b": _pick(KINDS, "p_partkey div 17")})
    return p.select("p_partkey", reconcile.type_compatible(F.col("a"), F.col("b")).alias("fits"))


def party_pairs(spark, d):
    names = F.array(F.col("p_name"), F.col("p_brand"))
    return _t(spark, d, "part").select("p_partkey", cascade.parties_meet(F.concat_ws(" ", F.split("p_name", " ")[0], F.substring("p_type", 1, 6), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))), names).alias("meet"))


def comparison_keys(spark, d):
    o = _t(spark, d, "orders")
    day, legal = _pick(DATES, "o_orderkey"), _pick(LEGALS, "o_orderkey")
    number = F.concat(F.lit("No. "), F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", cascade.day_key(day).alias("day"), cascade.legal_words(legal).alias("legal"), T.sequence_key(F.when(F.col("o_orderkey") % 3 > 0, number).otherwise("none")).cast("string").alias("sequence"), T.legal_key(legal).alias("legal_letters"))


def provider_failures(spark, d):
    return _t(spark, d, "events").select("event_id", review.provider_failure(_pick(MESSAGES, "event_id")).alias("failure"))


def resolved_checks(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("packet"), F.col("event_id").alias("check_id"), F.when(F.col("event_type") == "signup", "CANNOT_CONFIRM").when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"))
    said = e.where("check_id % 2 = 0").select("packet", "check_id", F.when(F.col("check_id") % 3 == 0, "PASS").when(F.col("check_id") % 3 == 1, "FAIL").otherwise("NOT_APPLICABLE").alias("status"), F.when(F.col("check_id") % 4 == 0, F.array(F.lit("ev"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return checks.resolved(e, said)


def ledger_cache(spark, d):
    scans = _t(spark, d, "documents").select(F.sha2("text", 256).alias("packet_hash"), "n_chars").groupBy("packet_hash").agg(F.max("n_chars").alias("n_chars"))
    cache = scans.where("n_chars % 3 = 0").withColumn("version", F.when(F.col("n_chars") % 2 == 0, packets.LEDGER_VERSION).otherwise(1))
    return packets.with_cache(packets.to_scan(scans, cache), cache).select("packet_hash", "n_chars", "cache_hit")


def pages_recovered(spark, d):
    i = F.col("doc_id")
    pages = _t(spark, d, "documents").select((i % 9).alias("packet"), i.alias("page"), "text", (i % 10 / 10).alias("confidence"), (F.col("n_chars") < 900).alias("needs_visual_review"))
    found = pages.where("page % 2 = 0").select("packet", "page", F.when(F.col("page") % 4 == 0, "").otherwise("recovered text").alias("text"), F.lit(0.75).alias("confidence"))
    out = packets.recovered(pages, found)
    return out.select("packet", "page", F.sha2("text", 256).alias("text"), "confidence", "needs_visual_review")


def pages_requested(spark, d):
    asked = F.concat_ws(",", F.col("turn").cast("string"), F.lit(" x"), (F.col("conv_id") % 5).cast("string"), F.lit("-3"), F.col("turn").cast("string"), F.lit("12"))
    rows = _t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("request"), asked.alias("pages"))
    return packets.requested_pages(rows, 2)


def outputs_parsed(spark, d):
    raw = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 7 == 1, "not json").otherwise(F.col("props")).alias("json"))
    return packets.model_output(raw.where("event_id % 7 <> 0"), "k int").select("event_id", "parsed.k")


def uploads_validated(spark, d):
    files = _t(spark, d, "pages").select(F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".pdf").otherwise(".txt")).alias("path"), F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.length("html")).alias("length"))
    good, bad = packets.validated(files)
    return good.select("path", F.lit("OK").alias("reason")).unionByName(bad.select("path", "reason"))


def evidence_union(spark, d):
    rows = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_orderkey").alias("pos"), F.array((F.col("l_partkey") % 7).cast("string"), F.col("l_linenumber").cast("string")).alias("evidence"))
    return merge.union_by_identity(rows, ["l_suppkey", "l_returnflag"], "pos").withColumn("evidence", F.array_join("evidence", ","))


def question_citations(spark, d):
    i = F.col("doc_id")
    pages = _t(spark, d, "documents").select((i % 5).alias("packet"), i.alias("page"), "text", (i % 13 == 0).alias("blank"))
    quote = F.when(i % 4 == 0, F.substring("text", 5, 70)).when(i % 4 == 1, F.concat(F.substring("text", 5, 40), F.lit(" qzx vbn"))).when(i % 4 == 2, "nothing of this page").otherwise("")
    cited = _t(spark, d, "documents").select((i % 5).alias("packet"), i.alias("answer"), F.when(i % 6 == 0, i + 1).otherwise(i).alias("page"), quote.alias("quote"))
    return retrieval.citations(cited, pages).select("answer", "page", "supported")


QUERIES = {f.__name__: f for f in (lien_statuses, type_pairs, party_pairs, comparison_keys, provider_failures, resolved_checks, ledger_cache, pages_recovered, pages_requested, outputs_parsed, uploads_validated, evidence_union, question_citations)}


def _of(values: list[str | None], i: str) -> str:
    return "[" + ",".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({i})%{len(values)}+1]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x},'')),'[^a-z0-9$#./''-]+',' ','g'))"


_GROUPS = ["deed of trust|mortgage|security deed", "assignment", "release|satisfaction|reconveyance", "judgment|lien", "trustee|foreclosure", "deed", "plat|survey"]
_FIT = " or ".join(f"(regexp_matches(a,'{g}') and regexp_matches(b,'{g}'))" for g in _GROUPS)
_DAY = {"1/2/95": "2095-01-02", "12-31-2020": "2020-12-31", "2020-03-04": "2020-03-04", "March 5, 2020": "2020-03-05", "Mar 5, 2020": "2020-03-05", "5 March 2020": "2020-03-05", "no date": "no date", "Needs review": "", None: "", "recorded 3/4/2021 here": "2021-03-04"}
_LEGAL = {0: "lot 1 of oak block", 1: "lot 1 of oak block", 2: "lot-1 of oak block", 3: "", 4: "", 5: "theory of lot"}
_LETTERS = {0: "LOT1OFOAKBLOCK", 1: "LOT1OFOAKBLOCK", 2: "LOT1OFOAKBLOCK", 3: "NEEDSREVIEW", 4: "", 5: "THEORYOFLOT"}
_TOKENS = f"list_filter(string_split({_norm('quote')},' '), lambda t: len(t)>1)"

ORACLES = {
    "lien_statuses": f"select o_orderkey, case when o_orderkey%17=0 or said in ('Released','Paid in full','satisfied of record','Cancelled') then 'RELEASED' when o_custkey%4=0 or said in ('Open','unreleased','unpaid','affects title','Unsatisfied','ACTIVE') then 'OPEN' else 'UNKNOWN' end status from (select *, {_of(STATUSES, 'o_orderkey')} said from orders)",
    "type_pairs": f"select p_partkey, a='' or b='' or contains(a,b) or contains(b,a) or {_FIT} fits from (select p_partkey, {_norm(_of(KINDS, 'p_partkey'))} a, {_norm(_of(KINDS, 'p_partkey//17'))} b from part)",
    "party_pairs": f"select p_partkey, case when len(ts)=0 then true else len(list_filter(ts, lambda t: contains(have,t)))>=0.6*len(ts) end meet from (select p_partkey, list_filter(string_split({_norm('''split_part(p_name,' ',1)||' '||substr(p_type,1,6)||case when p_partkey%3=0 then ' '||p_brand else '' end''')},' '), lambda t: len(t)>2) ts, {_norm('''p_name||' '||p_brand''')} have from part)",
    "comparison_keys": f"select o_orderkey, {_of(list(_DAY.values()), 'o_orderkey')} as day, {_of(list(_LEGAL.values()), 'o_orderkey')} legal, case when o_orderkey%3>0 then (o_orderkey::varchar||o_custkey::varchar)::hugeint::varchar end sequence, {_of(list(_LETTERS.values()), 'o_orderkey')} legal_letters from orders",
    "provider_failures": f"select event_id, {_of(['RATE_LIMIT', 'QUOTA', 'RATE_LIMIT', None, None, None], 'event_id')} failure from events",
    "resolved_checks": "select user_id packet, event_id check_id, case when event_type='error' then 'FAIL' when event_type<>'signup' then 'PASS' when event_id%2=1 then 'CANNOT_CONFIRM' when event_id%3=2 then 'NOT_APPLICABLE' when event_id%4>0 then 'CANNOT_CONFIRM' when event_id%3=0 then 'PASS' else 'FAIL' end status from events",
    "ledger_cache": "select sha256(text) packet_hash, max(n_chars) n_chars, max(n_chars)%6=0 cache_hit from documents group by 1",
    "pages_recovered": "select doc_id%9 packet, doc_id page, case when n_chars<900 and doc_id%4=2 then sha256('recovered text') else sha256(text) end text, case when n_chars<900 and doc_id%4=2 then 0.75 else doc_id%10/10 end confidence, n_chars<900 and doc_id%4<>2 needs_visual_review from documents",
    "pages_requested": "with p as (select distinct conv_id*100+turn request, unnest([turn, conv_id%5, 12]) page from conversations) select request, page, row_number() over (partition by request order by page)<=2 processed from p where page>0",
    "outputs_parsed": "select event_id, case when event_id%7>1 then json_extract(props,'$.k')::int end k from events where event_id%7>0",
    "uploads_validated": "select url||case page_id%3 when 0 then '.PDF' when 1 then '.pdf' else '.txt' end path, case when page_id%3=2 then 'WRONG_TYPE' when page_id%5=0 or length(html)=0 then 'EMPTY_PACKET' else 'OK' end reason from pages",
    "evidence_union": "select l_suppkey, l_returnflag, array_to_string(list_sort(list_distinct(flatten(list([(l_partkey%7)::varchar, l_linenumber::varchar])))),',') evidence, min(l_orderkey) pos from lineitem group by 1,2",
    "question_citations": f"""with c as (select doc_id answer, doc_id%5 packet, case when doc_id%6=0 then doc_id+1 else doc_id end page, case doc_id%4 when 0 then substr(text,5,70) when 1 then substr(text,5,40)||' qzx vbn' when 2 then 'nothing of this page' else '' end quote from documents),
 p as (select doc_id page, doc_id%5 packet, {_norm('text')} p from documents where doc_id%13>0)
 select answer, c.page, coalesce({_norm('quote')}<>'' and p<>'' and (contains(p,{_norm('quote')}) or (len({_TOKENS})>=4 and len(list_filter({_TOKENS}, lambda t: list_contains(string_split(p,' '),t)))>=0.84*len({_TOKENS}))), false) supported from c left join p on p.page=c.page and p.packet=c.packet""",
}
