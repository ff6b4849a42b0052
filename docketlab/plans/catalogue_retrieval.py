"""Queries of retrieval over documents as pages, benchmark items as questions and parts as instruments, with SQL twins.
Packets are remainders of the ids, so that each question has a packet of many pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import retrieval

_N = 40


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _questions(spark, d):
    i = F.col("item_id")
    return _t(spark, d, "benchmark").select((i % _N).alias("packet"), i.alias("question"), F.concat(F.lit("What of page "), (i % 100).cast("string"), F.lit("? "), F.col("text")).alias("text"))


def question_pages(spark, d):
    doc = F.col("doc_id")
    pages = _t(spark, d, "documents").select((doc % _N).alias("packet"), doc.alias("page"), F.col("lang").alias("hint"), "text", (doc % 23 == 0).alias("blank"), (doc % 5 == 0).alias("unseen"))
    evidence = _t(spark, d, "benchmark").select((F.col("item_id") % _N).alias("packet"), F.col("item_id").alias("page"), F.col("item_id").alias("id"), F.lit("Deed").alias("kind"), F.lit(None).cast("string").alias("number"), F.col("text").alias("quote"))
    return retrieval.top_pages(_questions(spark, d), pages, evidence)


def question_instruments(spark, d):
    p = F.col("p_partkey")
    rows = _t(spark, d, "part").select((p % _N).alias("packet"), p.alias("id"), (-p).alias("pos"), F.concat_ws(" ", "p_name", "p_type", F.when(p % 7 == 0, "nothing-interesting")).alias("text"))
    return retrieval.top_rows(_questions(spark, d).where("packet % 2 = 0"), rows, 25, 12)


def question_checks(spark, d):
    c = _t(spark, d, "conversations")
    rows = c.select((F.col("conv_id") % _N).alias("packet"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("pos"), "text")
    return retrieval.top_rows(_questions(spark, d), rows, 6)


QUERIES = {f.__name__: f for f in (question_pages, question_instruments, question_checks)}


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}),'[“”‘’]','''','g'),'[^a-z0-9$#./''-]+',' ','g'))"


_STOP = "['the','and','for','with','from','that','this','what','where','when','does','did','was','were','are','is','has','have','had','who','why','how','can','could','would','should','into','about','title','report','packet','document','documents','page']"
_Q = f"q as (select item_id%{_N} packet, item_id question, item_id%100 named, list_filter(list_distinct(string_split({_norm("'What of page '||item_id%100||'? '||text")},' ')), lambda t: len(t)>2 and not list_contains({_STOP},t)) toks from benchmark)"
_HELD = "len(list_filter(toks, lambda t: contains(x,t)))"

ORACLES = {
    "question_pages": f"""with {_Q}, p as (select doc_id%{_N} packet, doc_id page, {_norm("lang||' '||text")} x, doc_id%5=0 unseen from documents where doc_id%23>0),
 e as (select item_id%{_N} packet, item_id page, {_norm("'Deed '||text")} x from benchmark),
 b as (select question, e.page, sum({_HELD}*4) n from q join e on e.packet=q.packet group by 1,2),
 s as (select q.packet, q.question, p.page, (coalesce(list_sum(list_transform(toks, lambda t: least(5, (len(x)-len(replace(x,t,'')))//len(t)) * (case when len(t)>7 then 2 else 1 end))),0) + coalesce(b.n,0) + case when p.page=named and named>0 then 1000 else 0 end + case when unseen then -4 else 0 end)::bigint score from q join p on p.packet=q.packet left join b on b.question=q.question and b.page=p.page)
 select * from (select *, row_number() over (partition by question order by score desc, page) rank from s) where rank<=12""",
    "question_instruments": f"""with {_Q}, r as (select p_partkey%{_N} packet, p_partkey id, {_norm("concat_ws(' ', p_name, p_type, case when p_partkey%7=0 then 'nothing-interesting' end)")} x from part),
 s as (select q.packet, question, id, {_HELD} score from q join r on r.packet=q.packet where q.packet%2=0), b as (select * from (select *, row_number() over (partition by question order by score desc, id desc) rank from s where score>0) where rank<=25)
 select * from b union all select q.packet, q.question, f.id, 0, f.rank from q join (select packet, id, row_number() over (partition by packet order by id desc) rank from r qualify rank<=12) f on f.packet=q.packet where q.packet%2=0 and q.question not in (select question from b)""",
    "question_checks": f"""with {_Q}, r as (select conv_id%{_N} packet, conv_id*1000+turn id, turn pos, {_norm('text')} x from conversations), s as (select q.packet, question, id, pos, {_HELD} score from q join r on r.packet=q.packet)
 select packet, question, id, score, rank from (select *, row_number() over (partition by question order by score desc, pos, id) rank from s where score>0) where rank<=6""",
}
