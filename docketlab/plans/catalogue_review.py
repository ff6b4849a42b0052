"""Queries over the smaller review operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlab.operators import graph, review


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lien_holder(spark, d):
    roles = F.array(F.lit("Grantor"), F.lit("Lender"), F.lit("Trustee"), F.lit("Owner"))
    o = _t(spark, d, "orders").withColumn("i", (F.col("o_orderkey") % 4 + 1).cast("int"))
    party = lambda name, role: F.struct(F.lit(name).alias("name"), role.alias("role"))
    parties = F.array(party("A", F.element_at(roles, F.col("i"))), party("B", F.element_at(roles, (F.col("o_custkey") % 4 + 1).cast("int"))))
    return o.select("o_orderkey", review.holder(parties).alias("holder"))


def page_mentions(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("see page #"), F.col("turn"), F.lit(" and Page "), F.col("conv_id") % 7, F.lit(" "), "text").alias("q"))
    return c.select("conv_id", "turn", F.array_join(review.page_mentions(F.col("q")), ",").alias("pages"))


def _questions(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")


def retrieve_checks(spark, d):
    return review.top_matches(_questions(spark, d), _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), 6)


def retrieve_instruments(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 50 == 0, "inin that with")).alias("text"))
    return review.top_matches(_questions(spark, d), rows, 25, 12)


def checker_resolutions(spark, d):
    e = _t(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "PASS").when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "view", "NOT_APPLICABLE").otherwise("MAYBE")
    said = e.select(F.col("event_id").alias("key"), status.alias("status"), F.when(F.col("user_id") % 3 > 0, F.array(F.col("user_id") % 20, F.col("user_id") % 9 + 10)).otherwise(F.array().cast("array<bigint>")).alias("evidence"))
    known = spark.range(18).select("id", (F.col("id") % 4 > 0).alias("verified"))
    return review.resolutions(said, known)


def confirm_all(spark, d):
    e = _t(spark, d, "events")
    own = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).select("user_id", "event_type", F.when(F.col("n") % 2 == 0, "PASS").otherwise("FAIL").alias("status"))
    return review.confirm_all(own, e.where(F.col("value") > 90), ["user_id", "event_type"])


def state_rules(spark, d):
    o = _t(spark, d, "orders")
    own = o.select(F.col("o_orderkey").alias("review"), F.when(F.col("o_orderkey") % 3 == 0, " washington").when(F.col("o_orderkey") % 3 == 1, "wa").otherwise("TX").alias("state"), (F.col("o_orderkey") % 2).alias("juniors"), (F.col("o_orderkey") % 5 == 0).alias("federal"), (F.col("o_custkey") % 3 > 0).alias("foreclosure"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey")).alias("target"), (F.col("o_custkey") % 7 - 3).alias("open"))
    return review.state_rules(own)


def merged_requirements(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("review"), F.col("l_returnflag").alias("code"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("severity"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"))
    return review.merged_requirements(rows.groupBy("review", "code", "pos").agg(F.max("severity").alias("severity")))


def numbered_text(spark, d):
    e = _t(spark, d, "events").select("user_id", (F.col("event_id") % 20 + 1).alias("question"), "event_type", "event_id")
    c = e.groupBy("user_id", "question").agg(F.max_by("event_type", "event_id").alias("status"))
    return review.numbered_text(c, "user_id")


def exceptions_text(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"), F.col("event_id").cast("string").alias("label"))
    return review.exceptions_text(e, "user_id")


def json_export(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("owner"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return review.json_lines(c, {"owner": F.col("owner"), "segment": F.col("segment")})


def matter_key(spark, d):
    c = _t(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("client"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("order_number"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey").cast("string")).alias("parcel"), F.lit(None).cast("string").alias("address"), F.col("c_custkey").cast("string").alias("packet"))
    return review.matter_key(graph.identity_keys(rows))


def controlling_loan(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("lien"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey")).alias("target"))
    return review.controlling(o)


def blank_pages(spark, d):
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("page"), (F.col("n_chars") % 1000 / 1_000_000).alias("ink"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    return review.ink_blank(p)


def ocr_lines(spark, d):
    w = _t(spark, d, "events").select((F.col("user_id") % 30).alias("page"), F.col("user_id").alias("line"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")).alias("word"), (F.col("event_id") % 101 - 1).alias("conf"))
    return review.tsv_lines(w)


def question_tokens(spark, d):
    q = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("What is the lien position, and who owns this? "), "text").alias("q"))
    return q.select("conv_id", "turn", F.sha2(F.array_join(F.array_sort(review.question_tokens(F.col("q"))), " "), 256).alias("tokens"))


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c},'')),'[“”‘’]','''','g'),'[^a-z0-9$#./'' -]+',' ','g'),'[ \t\n\r\f]+',' ','g'))"""
_STOP = "[" + ",".join(f"'{w}'" for w in review.STOP) + "]"
_ASKED = f"asked as (select item_id question, unnest(list_filter(list_distinct(string_split({_NORM.format(c='text')},' ')), lambda x: length(x)>2 and not list_contains({_STOP},x))) t from benchmark)"
_WORDS = r"""trim(regexp_replace(upper(coalesce({c},'')),'[^A-Z0-9]+',' ','g'))"""

QUERIES = {f.__name__: f for f in (lien_holder, page_mentions, retrieve_checks, retrieve_instruments, checker_resolutions, confirm_all, state_rules, merged_requirements, numbered_text, exceptions_text, json_export, matter_key, controlling_loan, blank_pages, ocr_lines, question_tokens)}

ORACLES = {
    "lien_holder": "with r as (select o_orderkey, ['Grantor','Lender','Trustee','Owner'][o_orderkey%4+1] a, ['Grantor','Lender','Trustee','Owner'][o_custkey%4+1] b from orders) select o_orderkey, case when a='Lender' then 'A' when b='Lender' then 'B' when a='Trustee' then 'A' when b='Trustee' then 'B' else 'Needs review' end holder from r",
    "page_mentions": r"select conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('see page #'||turn||' and Page '||(conv_id%7)||' '||text,'(?i)\bpage\s*#?\s*([0-9]{1,4})\b',1), lambda x: x::int))),',') pages from conversations",
    "retrieve_checks": f"with {_ASKED}, w as (select conv_id*1000+turn id, unnest(list_distinct(string_split({_NORM.format(c='text')},' '))) t from conversations), s as (select question, id, count(*) score from w join asked using(t) group by 1,2) select * from (select *, row_number() over (partition by question order by score desc, id) rank from s) where rank<=6",
    "retrieve_instruments": f"with {_ASKED}, p as (select p_partkey id, p_name||case when p_partkey%50=0 then ' inin that with' else '' end txt from part), w as (select id, unnest(list_distinct(string_split({_NORM.format(c='txt')},' '))) t from p), s as (select question, id, count(*) score from w join asked using(t) group by 1,2), b as (select * from (select *, row_number() over (partition by question order by score desc, id) rank from s) where rank<=25) select question, id, score, rank from b union all select item_id, id, 0, rank from benchmark, (select id, row_number() over (order by id) rank from p qualify rank<=12) where item_id not in (select question from b)",
    "checker_resolutions": "with s as (select event_id as key, case event_type when 'click' then 'PASS' when 'error' then 'FAIL' when 'view' then 'NOT_APPLICABLE' else 'MAYBE' end status, unnest(case when user_id%3>0 then [user_id%20, user_id%9+10] else [null] end) id from events), a as (select key, status, count(case when id<18 then 1 end) n, bool_and(coalesce(id<18 and id%4>0,false)) strong from s group by 1,2) select key, case when status='MAYBE' or (status in ('PASS','FAIL') and not (n>0 and strong)) then 'CANNOT_CONFIRM' else status end status, n from a",
    "confirm_all": "select user_id, event_type, 'CONFIRM' decision from (select user_id, event_type from events group by 1,2 having count(*)%2=0) a where not exists (select 1 from events e where e.value>90 and e.user_id=a.user_id and e.event_type=a.event_type)",
    "state_rules": "with o as (select o_orderkey review, o_orderkey%2>0 or (o_custkey%2=1 and o_custkey%7>3) j, o_orderkey%5=0 f from orders where o_orderkey%3<2 and o_custkey%3>0) select review, 'WA_RC61_24_030_DEFAULT_NOTICE' code, 'INFO' severity from o union all select review, 'WA_RC61_24_040_NOTICE_OF_SALE', 'INFO' from o union all select review, 'WA_RC61_24_040_JUNIOR_NOTICE', 'REVIEW' from o where j union all select review, 'FED_IRC7425_NONJUDICIAL_NOTICE', 'REVIEW' from o where f",
    "merged_requirements": "with r as (select l_orderkey review, l_returnflag code, l_linenumber::bigint*1000000+l_partkey pos, max(l_linestatus||l_suppkey) severity from lineitem group by 1,2,3) select review, code, arg_max(severity,pos) severity, min(pos) pos from r group by 1,2",
    "numbered_text": "with c as (select user_id, event_id%20+1 question, arg_max(event_type,event_id) status from events group by 1,2) select user_id, string_agg(question||'. '||status, ' | ' order by question) as text from c group by 1",
    "exceptions_text": "with e as (select user_id, event_id, event_type='error' bad, bool_or(event_type='error') over (partition by user_id) any_bad from events), k as (select user_id, event_id, row_number() over (partition by user_id order by event_id) r from e where bad=any_bad) select user_id, string_agg(event_id::varchar, '; ' order by event_id) as text from k where r<=3 group by 1",
    "json_export": """select c_custkey as key, '{"owner":"'||c_name||'","segment":'||case when c_custkey%2=0 then '"'||c_mktsegment||'"' else 'null' end||'}' line from customer""",
    "matter_key": f"with c as (select c_custkey as key, {_WORDS.format(c='c_mktsegment')} s, c_name, c_nationkey from customer), k as (select key, case when key%4=0 then 'parcel' when key%3=0 then 'order' else 'packet' end kind, case when key%4=0 then c_nationkey::varchar when key%3=0 then {_WORDS.format(c='c_name')} else key::varchar end v, s from c) select key, kind||'_'||substr(sha256(s||'|'||kind||'|'||v),1,32) as identity from k",
    "controlling_loan": "select o_custkey packet, coalesce(max(case when o_orderkey%11=0 then o_orderkey end), case when count(*)=1 then min(o_orderkey) end) loan from orders where o_orderstatus='O' group by 1",
    "blank_pages": "select doc_id page, case when n_chars%1000<=800 then 'blank' else 'text' end source, case when n_chars%1000<=800 then 1.0::double else (doc_id%10)/10.0::double end confidence from documents",
    "ocr_lines": "with w as (select user_id%30 page, user_id as line, event_id, event_type word, event_id%101-1 conf from events where event_id%9<>0) select page, line, string_agg(word, ' ' order by event_id) as text, coalesce(round(avg(case when conf>=0 then conf/100.0::double end),6),0) confidence from w group by 1,2",
    "question_tokens": f"with q as (select conv_id, turn, 'What is the lien position, and who owns this? '||text q from conversations) select conv_id, turn, sha256(array_to_string(list_sort(list_filter(list_distinct(string_split({_NORM.format(c='q')},' ')), lambda x: length(x)>2 and not list_contains({_STOP},x))),' ')) tokens from q",
}
