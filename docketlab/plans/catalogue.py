"""Every query of the engine by name, over stand-in tables of the same shape, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.functions import text as T
from docketlab.operators import checks, evidence, graph, liens, merge, pages, reconcile
from docketlab.plans import catalogue_anchors, catalogue_audit, catalogue_cascade, catalogue_checks, catalogue_extractions, catalogue_foreclosure, catalogue_graph, catalogue_manifests, catalogue_profiles, catalogue_record, catalogue_retrieval, catalogue_review, catalogue_units
from docketlab.plans.oracles import ORACLES as _ORACLES

Query = Callable[[SparkSession, str], DataFrame]

#: Substitute vocabulary that occurs in the stand-in texts, first match wins.
CLASSES = [("License", "(?i)license|copyright"), ("Contact", "[A-Za-z0-9._]+@[a-z0-9.]+"), ("Secret", "(?i)\\b(?:token|secret|password) ="), ("Short", "^[\\s\\S]{0,199}$")]
SIGNALS = ["(?i)license", "@", "\\d{3}", "!!", "\\|", "\\$\\$", "(?i)\\bthe\\b", "(?i)\\bder\\b"]
ORDERS = [("Licensed", "(?i)\\blicensed under the [a-z]+"), ("Contact", "[a-z0-9._]+@[a-z0-9.]+"), ("Table", "\\| [a-z]+ \\|")]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _liens(spark: SparkSession, d: str) -> DataFrame:
    """Orders as liens: customer = packet, order date = recording date, status O / F / P."""
    kind = F.when(F.col("o_orderkey") % 7 == 0, "Federal Tax Lien").when(F.col("o_orderkey") % 7 < 5, "Deed of Trust").otherwise("Judgment Lien")
    return _t(spark, d, "orders").select(
        F.col("o_custkey").alias("packet"),
        F.col("o_orderkey").alias("lien"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "RELEASED").otherwise("UNKNOWN").alias("status"),
        F.to_date("o_orderdate").alias("recorded"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("sequence"),
        kind.alias("kind"),
    )


def _calm(spark: SparkSession, d: str) -> DataFrame:
    """The same with UNKNOWN read as released, so that positions are not blocked."""
    return _liens(spark, d).withColumn("status", F.when(F.col("status") == "UNKNOWN", "RELEASED").otherwise(F.col("status"))).withColumn("sequence", F.col("lien"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("source").alias("packet"), F.col("doc_id").alias("page"), "text", F.col("n_chars").alias("char_count"))


def _ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return _pages(spark, d).withColumn("page", F.row_number().over(Window.partitionBy("packet").orderBy("page")))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """Events as checks of a (user, day) review: signup unresolved, error failed, else passed."""
    status = F.when(F.col("event_type") == "signup", "CANNOT_CONFIRM").when(F.col("event_type") == "error", "FAIL").otherwise("PASS")
    ids = F.array(*[F.lit(c[0]) for c in D.CHECKS])
    return _t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.element_at(ids, (F.col("event_id") % 26 + 1).cast("int")).alias("check_id"), status.alias("status"), "event_id", "ts")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.length("props").alias("chars"), (F.col("event_id") % 17).alias("signals"), (F.col("event_id") % 100 / 100).alias("confidence"))


def lien_position(spark, d):
    return liens.lien_stack(_liens(spark, d)).where("status = 'OPEN'").select("packet", "lien", "position", "label", "basis", "confidence")


def lien_blockers(spark, d):
    return liens.lien_stack(_liens(spark, d)).groupBy("status", F.coalesce("blocker", F.lit("-")).alias("blocker")).agg(F.count("*").alias("n"))


def lien_tie_ambiguity(spark, d):
    stack = liens.lien_stack(_liens(spark, d).where("status = 'OPEN'").withColumn("recorded", F.trunc("recorded", "month")))
    return stack.select("packet", "lien", F.coalesce("blocker", F.lit("-")).alias("blocker"))


def lien_status_counts(spark, d):
    return _liens(spark, d).groupBy("packet").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OPEN", "RELEASED", "UNKNOWN")])


def _targets(stack: DataFrame) -> DataFrame:
    return liens.automatic_target(stack, F.col("lien") % 2 == 0)


def _targeted(stack: DataFrame) -> DataFrame:
    return liens.targeted(stack, F.col("lien") % 2 == 0)


def auto_target(spark, d):
    return _targets(liens.lien_stack(_calm(spark, d))).where("target is not null")


def senior_junior_split(spark, d):
    return liens.split_by_target(_targeted(liens.lien_stack(_calm(spark, d))))


def evidence_through_target(spark, d):
    return liens.evidence_through(liens.lien_stack(_calm(spark, d)))


def foreclosure_requirements(spark, d):
    return liens.requirements(_targeted(liens.lien_stack(_liens(spark, d))))


def foreclosure_status(spark, d):
    return liens.analysis(_targeted(liens.lien_stack(_liens(spark, d))))


def page_hint(spark, d):
    return _pages(spark, d).select("page", T.first_match(F.col("text"), CLASSES, "Unclassified").alias("hint"))


def front_summary_score(spark, d):
    return _pages(spark, d).select("page", T.signal_score(F.col("text"), SIGNALS).cast("long").alias("score"))


def order_type_detect(spark, d):
    return _pages(spark, d).select("page", pages.order_type(F.col("text"), ORDERS).alias("order_type")).where("order_type is not null")


def normalize_text(spark, d):
    return _pages(spark, d).select("page", F.sha2(T.normalize(F.col("text")), 256).alias("norm"))


def compact_whitespace(spark, d):
    return _pages(spark, d).select("page", F.sha2(T.compact(F.col("text")), 256).alias("compact"))


def page_ledger(spark, d):
    return pages.ledger(_pages(spark, d)).select("packet", "page_count", "chars", "readable", "blank", F.array_join("low_pages", ",").alias("low_pages"), "coverage", "ready")


def low_text_budget(spark, d):
    return pages.recovery_budget(_pages(spark, d), 600, 3).select("packet", "page", F.col("turn").cast("long").alias("turn"), "allowed")


def run_sheet_segment(spark, d):
    return pages.summary_segment(_ranked_pages(spark, d), "(?i)\\bthe\\b", ["(?i)\\bthe\\b", "\\|"], "(?i)license").select("packet", F.col("page").cast("long").alias("page"))


def shard_pack(spark, d):
    return pages.shards(_pages(spark, d), 12, 20_000).select("packet", "page", F.col("shard").cast("long").alias("shard"))


def html_page_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2(pages.markup_text(F.col("html")), 256).alias("text"))


def tsv_line_mean(spark, d):
    lines = _t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("words"), F.sum(F.length("text")).alias("chars"))
    return lines.groupBy("conv_id").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.round(F.sum("chars") / F.sum("words"), 6).alias("mean"))


def first_accepted_provider(spark, d):
    return pages.first_accepted(_candidates(spark, d), 10, 0.5)


def best_candidate(spark, d):
    return pages.best_candidate(_candidates(spark, d))


def evidence_ids(spark, d):
    q = _quotes(spark, d)
    return q.select("quote_id", T.evidence_id(F.lit("packet"), F.col("quote_id"), F.lit("Benchmark"), F.lit(""), F.col("quote")).alias("evidence_id"))


def _grounded(spark, d):
    return evidence.grounded(_quotes(spark, d), _t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


def fuzzy_grounding(spark, d):
    return _grounded(spark, d).select("quote_id", "page_id", "exact", "matched", "total")


def evidence_state(spark, d):
    return evidence.evidence_state(_quotes(spark, d), _grounded(spark, d))


def dedup_anchors(spark, d):
    return evidence.first_by_key(_pages(spark, d), F.sha2(T.normalize(F.col("text")), 256), [F.col("page")]).select("page", "packet")


def majority_string(spark, d):
    return merge.majority(_t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("pos")))


def best_fact_tie(spark, d):
    e = _t(spark, d, "events")
    return merge.best_fact(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.to_date("ts").alias("evidence"), (F.col("event_id") % 100 / 100).alias("confidence")))


def merge_instruments(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").alias("qty"))
    return merge.merge_rows(rows, "number", ["flag", "qty"])


def fold_entries(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("packet"), F.col("turn").cast("int").alias("pos"), F.col("role").alias("key"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")).alias("value"))
    return merge.fold_entries(rows).select("packet", F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["key"], x["value"])), "|").alias("entries"))


def _sums(spark, d):
    line = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    own = _t(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return line, own


def reconcile_amounts(spark, d):
    line, own = _sums(spark, d)
    close = F.abs(F.col("amount") - F.col("source_amount")) * 2 <= F.col("source_amount")
    return reconcile.matched(line, own, close).select("number", F.col("amount").cast("string").alias("amount"), F.col("source_amount").cast("string").alias("source_amount"), "status")


def reconcile_counts(spark, d):
    line, own = _sums(spark, d)
    close = F.abs(F.col("amount") - F.col("source_amount")) * 2 <= F.col("source_amount")
    return reconcile.counts(reconcile.matched(line, own, close).withColumn("bucket", F.col("number") % 10), "bucket")


def reconcile_greedy(spark, d):
    o = _t(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    line, _ = _sums(spark, d)
    entries = line.join(o, F.col("number") == F.col("o_orderkey")).select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("entry"), "amount")
    return reconcile.greedy(entries, o.select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("source"), F.col("o_totalprice").alias("amount")), 0.25)


def omitted_sources(spark, d):
    return reconcile.omitted(_t(spark, d, "orders").select(F.col("o_orderkey").alias("number")), _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("number")), "number")


def missing_references(spark, d):
    parts = _t(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return reconcile.omitted(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def release_match(spark, d):
    o = _t(spark, d, "orders")
    own = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("lien"), F.col("o_orderkey").cast("string").alias("number"))
    rel = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("release"), F.col("o_orderkey").cast("string").alias("number"), (F.col("o_orderkey") + 1).cast("string").alias("refers"), F.concat(F.lit("releases "), (F.col("o_orderkey") * 10).cast("string")).alias("text"))
    return reconcile.releases(own, rel)


def _deeds(spark, d):
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("deed"), F.col("o_orderdate").alias("dated"), F.array(F.substring("o_orderpriority", 1, 1)).alias("grantees"), F.array(F.substring("o_orderpriority", 1, 1), (F.col("o_orderkey") % 5 + 1).cast("string")).alias("grantors"))


def chain_continuity(spark, d):
    return reconcile.chain(_deeds(spark, d))


def chain_by_packet(spark, d):
    return reconcile.chain_of_packet(reconcile.chain(_deeds(spark, d)))


def checks_grounded(spark, d):
    labels = _t(spark, d, "labels")
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    c = docs.join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "FAIL").otherwise("CANNOT_CONFIRM").alias("status"), F.when(F.col("n_chars") >= 400, F.array("doc_id")).otherwise(F.array().cast("array<bigint>")).alias("evidence"))
    return evidence.gated(c).select("doc_id", "status")


def qc_reduce(spark, d):
    return checks.reduced(_checks(spark, d), ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), "n", "failed", "unresolved", "qc_status", "pass_fail")


def qc_issues(spark, d):
    found = checks.issues(_checks(spark, d).withColumn("packet", F.col("user_id")))
    return found.groupBy("packet", "code", "severity").agg(F.count("*").alias("n"))


def qc_readiness(spark, d):
    return checks.readiness(checks.issues(_checks(spark, d).withColumn("packet", F.col("user_id"))), "packet")


def accuracy_areas(spark, d):
    out = checks.audit_areas(_checks(spark, d), D.areas(spark), ["user_id", "day"])
    return out.select("user_id", F.col("day").cast("string").alias("day"), "area", "status")


def integrity_guard(spark, d):
    c = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select(F.col("source").alias("packet"), (F.col("doc_id") % 40).alias("check_id"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("status"), F.col("doc_id").alias("page"))
    bad = _t(spark, d, "documents").where("n_chars < 900").select(F.col("source").alias("packet"), F.col("doc_id").alias("page"))
    return checks.integrity_guard(c, bad)


def latest_decision(spark, d):
    return checks.latest(_t(spark, d, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


def decision_overlay(spark, d):
    first = checks.latest(_checks(spark, d), ["user_id", "check_id"], [F.col("event_id").asc()]).select("user_id", "check_id", "status")
    said = checks.latest(_checks(spark, d), ["user_id", "check_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "check_id", F.col("status").alias("decided"))
    return checks.overlaid(first, said.where("decided <> 'PASS'"), ["user_id", "check_id"]).select("user_id", "check_id", "status", "final", "overridden")


def matter_revision(spark, d):
    return graph.revisions(_t(spark, d, "events").select((F.col("user_id") % 40).alias("matter"), F.col("user_id").alias("review"), "ts").withColumnRenamed("ts", "at"))


def identity_keys(spark, d):
    c = _t(spark, d, "customer")
    return graph.identity_keys(c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("client"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("order_number"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey").cast("string")).otherwise("Unknown").alias("parcel"), F.lit(None).cast("string").alias("address"), F.col("c_custkey").cast("string").alias("packet")))


def _nodes(spark, d):
    o = _t(spark, d, "orders")
    none = F.array().cast("array<bigint>")
    a = o.select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.lit("party").alias("type"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("pos"), F.array("o_orderkey").alias("evidence"))
    b = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("instrument").alias("type"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("pos"), none.alias("evidence"))
    return a.unionByName(b)


def _edges(spark, d):
    o = _t(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("PARTY_TO").alias("type"))
    li = _t(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("REPORTS").alias("type"))
    return graph.edges(o.unionByName(li))


def graph_nodes(spark, d):
    return graph.upserted(_nodes(spark, d)).select("id", "type", "label", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


def graph_edges(spark, d):
    return _edges(spark, d)


def graph_neighbours(spark, d):
    seeds = _t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("seed"))
    return graph.neighbours(seeds, _edges(spark, d), 4)


def retrieve_pages(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.col("text"))
    return graph.top_pages(q, _t(spark, d, "documents").select(F.col("doc_id").alias("page"), "text"))


def citations_verified(spark, d):
    cited = _grounded(spark, d).select("quote_id", (F.col("page_id") + F.col("quote_id") % 2).alias("page_id"))
    return graph.verified_citations(cited, _grounded(spark, d))


def batch_metrics(spark, d):
    c = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return c.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("clear"), F.count_if(F.col("quality") == 0).alias("curative"), F.count_if(F.col("quality").isNull()).alias("review"))


def stage_order(spark, d):
    stages = F.array(*[F.lit(s) for s in D.STAGES[1:]])
    log = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.element_at(stages, (F.col("event_id") % 9 + 1).cast("int")).alias("stage"))
    return graph.illegal_steps(log).select("key", "seq", "stage", "before")


def _export(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 9 == 0, 'Needs "review"').otherwise(F.col("c_name")).alias("owner"), F.when(F.col("o_orderstatus") == "P", T.NEEDS_REVIEW).otherwise(F.col("o_orderpriority")).alias("position"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"))


def export_rows(spark, d):
    return graph.export_lines(_export(spark, d), {"owner": F.col("owner"), "position": F.col("position"), "amount": F.col("amount")})


def export_warnings(spark, d):
    return graph.export_warnings(_export(spark, d), {"owner": F.col("owner"), "position": F.col("position"), "amount": F.col("amount")})


def union_except_pages(spark, d):
    p = _pages(spark, d).groupBy("packet").agg(F.array_sort(F.collect_set(F.when(F.col("char_count") < 600, F.col("page")))).alias("low"), F.array_sort(F.collect_set(F.when(F.col("page") % 9 == 0, F.col("page")))).alias("skipped"))
    join = lambda c: F.array_join(c, ",")
    return p.select("packet", join(F.array_sort(F.array_union("low", "skipped"))).alias("requested"), join(F.array_except("skipped", "low")).alias("left_over"))


def scalar_keys(spark, d):
    o = _t(spark, d, "orders")
    price = F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    us = F.date_format("o_orderdate", "M/d/yyyy")
    return o.select(F.col("o_orderkey").alias("key"), T.money_key(price).alias("money"), T.date_key(us).alias("date"), T.ordinal(F.col("o_orderkey")).alias("nth"), T.alnum_key(F.col("o_orderpriority")).alias("alnum"), T.slug(F.col("o_orderpriority")).alias("slug"))


def page_serializer(spark, d):
    return pages.serialized(_pages(spark, d)).select("packet", F.sha2("body", 256).alias("body"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        lien_position, lien_blockers, lien_tie_ambiguity, lien_status_counts, auto_target, senior_junior_split, evidence_through_target, foreclosure_requirements, foreclosure_status,
        page_hint, front_summary_score, order_type_detect, normalize_text, compact_whitespace, page_ledger, low_text_budget, run_sheet_segment, shard_pack, html_page_text, tsv_line_mean,
        first_accepted_provider, best_candidate, evidence_ids, fuzzy_grounding, evidence_state, dedup_anchors, majority_string, best_fact_tie, merge_instruments, fold_entries,
        reconcile_amounts, reconcile_counts, reconcile_greedy, omitted_sources, missing_references, release_match, chain_continuity, chain_by_packet, checks_grounded, qc_reduce, qc_issues,
        qc_readiness, accuracy_areas, integrity_guard, latest_decision, decision_overlay, matter_revision, identity_keys, graph_nodes, graph_edges, graph_neighbours, retrieve_pages,
        citations_verified, batch_metrics, stage_order, export_rows, export_warnings, union_except_pages, scalar_keys, page_serializer,
    )
}

_MORE = (catalogue_review, catalogue_checks, catalogue_cascade, catalogue_graph, catalogue_extractions, catalogue_foreclosure, catalogue_audit, catalogue_record, catalogue_retrieval, catalogue_manifests, catalogue_anchors, catalogue_profiles, catalogue_units)
for _m in _MORE:
    QUERIES |= _m.QUERIES
ORACLES: dict[str, str] = dict(_ORACLES)
for _m in _MORE:
    ORACLES |= _m.ORACLES
