"""Smaller operators of a review: holders, mentions, retrieval of checks, resolutions, state rules, texts, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T

#: Words that carry no meaning in a question.
STOP = "the and for with from that this what where when does did was were are is has have had who why how can could would should into about title report packet document documents page".split()
#: Roles that hold a lien, and roles that owe it.
HOLDERS, DEBTORS = "(?i)beneficiary|mortgagee|lender|holder|creditor|claimant|lienor", "(?i)borrower|mortgagor|debtor|grantor|owner"
#: Process rules of a state, as data: code, severity, whether it needs interests to notify, a federal lien.
STATE_RULES = [
    ("WA", "WA_RC61_24_030_DEFAULT_NOTICE", "INFO", False, False),
    ("WA", "WA_RC61_24_040_NOTICE_OF_SALE", "INFO", False, False),
    ("WA", "WA_RC61_24_040_JUNIOR_NOTICE", "REVIEW", True, False),
    ("WA", "FED_IRC7425_NONJUDICIAL_NOTICE", "REVIEW", False, True),
]


def holder(parties: Column) -> Column:
    """First party in a holding role, else the first not in an owing role. parties: array<struct<name,role>>."""
    first = lambda test: F.get(F.filter(parties, test), F.lit(0))["name"]
    return F.coalesce(first(lambda p: p["role"].rlike(HOLDERS)), first(lambda p: ~p["role"].rlike(DEBTORS)), F.lit(T.NEEDS_REVIEW))


def question_tokens(text: Column) -> Column:
    words = F.filter(F.split(T.normalize(text), " "), lambda t: F.length(t) > 2)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP]))


def page_mentions(text: Column) -> Column:
    """Distinct page numbers that a question names ('page 3', 'page #12')."""
    found = F.regexp_extract_all(text, F.lit("(?i)\\bpage\\s*#?\\s*([0-9]{1,4})\\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def top_matches(questions: DataFrame, rows: DataFrame, k: int, fallback: int = 0) -> DataFrame:
    """question, id, score, rank: the k rows with the most question tokens in their text; where none has any,
    the first `fallback` rows. questions: question, text; rows: id, text. Tokens meet in an equi join."""
    asked = questions.select("question", F.explode(question_tokens(F.col("text"))).alias("t"))
    words = rows.select("id", F.explode(F.array_distinct(F.split(T.normalize(F.col("text")), " "))).alias("t"))
    scored = words.join(asked, "t").groupBy("question", "id").agg(F.count("*").alias("score"))
    w = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    best = scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    if not fallback:
        return best
    none = questions.join(best, "question", "left_anti").select("question")
    first = rows.orderBy("id").limit(fallback).select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("rank"))
    return best.unionByName(none.join(F.broadcast(first)).select("question", "id", F.lit(0).cast("long").alias("score"), "rank"))


def resolutions(said: DataFrame, known: DataFrame) -> DataFrame:
    """Checker output made safe: known evidence only, and a conclusive status without any becomes unresolved.
    said: key, status, evidence (array); known: id, verified."""
    ids = said.select("key", "status", F.explode_outer("evidence").alias("id"))
    have = ids.join(known.select("id", "verified"), "id", "left").groupBy("key", "status").agg(F.count("verified").alias("n"), F.bool_and(F.coalesce("verified", F.lit(False))).alias("strong"))
    weak = F.col("status").isin("PASS", "FAIL") & ~((F.col("n") > 0) & F.col("strong"))
    return have.select("key", F.when(weak | ~F.col("status").isin("PASS", "FAIL", "NOT_APPLICABLE"), "CANNOT_CONFIRM").otherwise(F.col("status")).alias("status"), "n")


def confirm_all(checks: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """A CONFIRM decision for each clean check that has none yet."""
    clean = checks.where(F.col("status").isin("PASS", "NOT_APPLICABLE"))
    return clean.join(decisions.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("CONFIRM").alias("decision"))


def state_code(state: Column) -> Column:
    up = F.upper(F.trim(state))
    return F.when(up == "WASHINGTON", "WA").otherwise(up)


def state_rules(reviews: DataFrame) -> DataFrame:
    """review, code, severity from the rule table. reviews: review, state, juniors (long), federal (boolean), and
    foreclosure (boolean: the order is confirmed as one), target (its lien, or null), open (open liens, long).

    Only foreclosures have process rules. Those to notify are the junior liens; while no target is known, nobody is
    junior or senior, and all open liens are."""
    table = reviews.sparkSession.createDataFrame(STATE_RULES, "state string, code string, severity string, needs_notice boolean, needs_federal boolean")
    own = reviews.withColumn("state", state_code(F.col("state")))
    notified = (F.col("juniors") > 0) | (F.col("target").isNull() & (F.col("open") > 0))
    hit = (~F.col("needs_notice") | notified) & (~F.col("needs_federal") | F.col("federal"))
    return own.where("foreclosure").join(F.broadcast(table), "state").where(hit).select("review", "code", "severity")


def merged_requirements(rows: DataFrame) -> DataFrame:
    """One row per code: the last value at the first place. rows: review, code, severity, pos."""
    return rows.groupBy("review", "code").agg(F.max_by("severity", "pos").alias("severity"), F.min("pos").alias("pos"))


def numbered_text(checks: DataFrame, by: str) -> DataFrame:
    """All numbered checks of a review in question order: '1. PASS | 2. FAIL | ...'. checks: by, question, status."""
    line = F.concat(F.col("question").cast("string"), F.lit(". "), "status")
    packed = checks.where("question is not null").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("question", line.alias("line")))).alias("x"))
    return packed.select(by, F.array_join(F.transform("x", lambda v: v["line"]), " | ").alias("text"))


def exceptions_text(checks: DataFrame, by: str, most: int = 3) -> DataFrame:
    """The first `most` failing labels, else the first `most` of all. checks: by, pos, status, label."""
    item = F.struct("pos", "label")
    packed = checks.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("status") == "FAIL", item))).alias("bad"), F.array_sort(F.collect_list(item)).alias("all"))
    pick = F.slice(F.when(F.size("bad") > 0, F.col("bad")).otherwise(F.col("all")), 1, most)
    return packed.select(by, F.array_join(F.transform(pick, lambda v: v["label"]), "; ").alias("text"))


def json_lines(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One JSON object per row, with null fields kept."""
    return rows.select("key", F.to_json(F.struct(*[v.alias(k) for k, v in columns.items()]), {"ignoreNullFields": "false"}).alias("line"))


def provider_failure(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(low.rlike("insufficient_quota|quota"), "QUOTA").when(low.rlike("\\b429\\b|rate limit"), "RATE_LIMIT")


def matter_key(keys: DataFrame) -> DataFrame:
    """The preferred identity of each review: parcel, then address, then order. keys: key, kind, identity."""
    order = F.when(F.col("kind") == "parcel", 0).when(F.col("kind") == "address", 1).when(F.col("kind") == "order", 2).otherwise(3)
    return keys.groupBy("key").agg(F.min_by("identity", order).alias("identity"))


def controlling(liens: DataFrame) -> DataFrame:
    """packet, loan: the target where there is one, else the sole security lien. liens: packet, lien, target."""
    agg = liens.groupBy("packet").agg(F.max("target").alias("target"), F.count("*").alias("n"), F.min("lien").alias("only"))
    return agg.select("packet", F.coalesce("target", F.when(F.col("n") == 1, F.col("only"))).alias("loan"))


def ink_blank(pages: DataFrame, limit: float = 0.0008) -> DataFrame:
    """Pages whose share of dark pixels is under the limit are blank, and sure. pages: page, ink, confidence."""
    blank = F.col("ink") <= limit
    return pages.select("page", F.when(blank, "blank").otherwise("text").alias("source"), F.when(blank, 1.0).otherwise(F.col("confidence")).alias("confidence"))


def tsv_lines(words: DataFrame) -> DataFrame:
    """page, line, text, confidence: recognised words joined in order per line; the mean of their confidences of
    0 or more, as a share. words: page, line, pos, word, conf."""
    w = words.where(F.trim("word") != "").groupBy("page", "line")
    packed = w.agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("x"), F.avg(F.when(F.col("conf") >= 0, F.col("conf") / 100)).alias("confidence"))
    return packed.select("page", "line", F.array_join(F.transform("x", lambda v: v["word"]), " ").alias("text"), F.coalesce(F.round("confidence", 6), F.lit(0.0)).alias("confidence"))
