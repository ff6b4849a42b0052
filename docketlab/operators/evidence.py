"""Grounding of quotes in page text, evidence ids and states, deduplication of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T

RATIO, MIN_TOKENS = 0.82, 4
#: A candidate page holds at least so many of a quote's rarest tokens, beyond those that may be missing.
SHARED = 3
#: The ratio for quotes that an answer to a question cites.
QUESTION_RATIO = 0.84


def quote_tokens(col: Column) -> Column:
    return F.filter(F.split(T.normalize(col), " "), lambda t: F.length(t) > 1)


def _candidates(asked: DataFrame, words: DataFrame, ratio: float) -> DataFrame:
    """quote_id, page_id of the pages that hold enough of a quote's rarest tokens. asked: quote_id, n, i, t (its n tokens);
    words: page_id, t (distinct words that are asked for)."""
    df = words.groupBy("t").agg(F.count("*").alias("df"))
    order = Window.partitionBy("quote_id").orderBy(F.coalesce("df", F.lit(0)), "t", "i")
    missing = F.greatest(F.floor(F.col("n") * (1 - ratio) + 1e-9), F.lit(2))
    probe = asked.where(F.col("n") >= MIN_TOKENS).join(df, "t", "left").withColumn("r", F.row_number().over(order)).where(F.col("r") <= missing + SHARED)
    shared = words.join(probe.select("quote_id", "t", "n"), "t").groupBy("quote_id", "page_id", "n").agg(F.count("*").alias("held"))
    return shared.where(F.col("held") >= F.least(F.col("n"), missing + SHARED) - missing).select("quote_id", "page_id")


def grounded(quotes: DataFrame, pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """quote_id, page_id, exact, matched, total of the quotes that pages contain: as a substring of the
    normalised text, or by at least `ratio` of at least MIN_TOKENS tokens.

    A page may lack (1 - ratio) * n of a quote's tokens, or two if it holds the quote but for its edges. Candidates come
    from an equi join on the quote's rarest tokens, SHARED more than may be missing: a page that holds fewer than SHARED
    of them (all but the missing ones of a short quote) is out. Candidates' tokens are counted by a join of the pairs with
    the quote's tokens and the page's words, and only pairs whose count is high enough for one of the two rules meet a text.
    Quotes too short for that are compared with all pages. quotes: quote_id, quote; pages: page_id, text.
    """
    q = quotes.select("quote_id", T.normalize(F.col("quote")).alias("q"), quote_tokens(F.col("quote")).alias("qt")).where("q <> ''")
    p = pages.select("page_id", T.normalize(F.col("text")).alias("p"))
    asked = q.select("quote_id", F.size("qt").alias("n"), F.posexplode("qt").alias("i", "t"))
    words = p.select("page_id", F.explode(F.array_distinct(F.split("p", " "))).alias("t")).join(asked.select("t").distinct(), "t", "left_semi")
    pairs = _candidates(asked, words, ratio)
    often = asked.groupBy("quote_id", "t").agg(F.count("*").alias("times"))
    hits = pairs.join(often, "quote_id").join(words, ["page_id", "t"]).groupBy("quote_id", "page_id").agg(F.sum("times").alias("matched"))
    n = F.size("qt")
    near = hits.join(q, "quote_id").where((F.col("matched") >= n - 2) | (F.col("matched") / n >= ratio)).join(p, "page_id")
    short = q.where(F.size("qt") < MIN_TOKENS).join(p, F.contains(F.col("p"), F.col("q")))
    pt = F.split("p", " ")
    short = short.withColumn("matched", F.size(F.filter("qt", lambda t: F.array_contains(pt, t))).cast("long"))
    both = near.select("quote_id", "page_id", "matched", "q", "qt", "p").unionByName(short.select("quote_id", "page_id", "matched", "q", "qt", "p"))
    both = both.select("quote_id", "page_id", F.contains(F.col("p"), F.col("q")).alias("exact"), "matched", F.size("qt").cast("long").alias("total"))
    return both.where(F.col("exact") | ((F.col("total") >= MIN_TOKENS) & (F.col("matched") / F.col("total") >= ratio)))


def evidence_state(quotes: DataFrame, found: DataFrame) -> DataFrame:
    """quote_id, state, pages: CONFIRMED where a page grounds the quote, NOT_STATED where it is missing."""
    hits = found.groupBy("quote_id").agg(F.count("*").alias("pages"))
    out = quotes.join(hits, "quote_id", "left")
    state = F.when(T.is_missing(F.col("quote")), "NOT_STATED").when(F.col("pages") > 0, "CONFIRMED").otherwise("UNCONFIRMED")
    return out.select("quote_id", state.alias("state"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


def first_by_key(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; ties are broken by the order's last column."""
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def gated(checks: DataFrame) -> DataFrame:
    """A PASS or FAIL without evidence cannot be confirmed. checks: status, evidence (array)."""
    bare = F.coalesce(F.size("evidence"), F.lit(0)) <= 0
    return checks.withColumn("status", F.when(F.col("status").isin("PASS", "FAIL") & bare, "CANNOT_CONFIRM").otherwise(F.col("status")))
