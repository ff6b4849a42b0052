"""Retrieval by substrings: which pages and rows a question's tokens occur in, letters in any place of a word.

A token has no blanks, so it occurs in a text as often as in the text's words. Texts are counted as words once, and
only the vocabulary, each distinct word once, is matched with tokens: by an equi join on runs of three letters, then
verified. No text meets a token, and nothing is scanned question by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T
from docketlab.operators import review
from docketlab.operators.anchors import contained
from docketlab.operators.evidence import QUESTION_RATIO

#: How a page scores.
MOST_HITS, LONG_TOKEN, EVIDENCE, MENTIONED, UNSEEN = 5, 7, 4, 1000, -4
PAGES, GRAM = 12, 3
#: Pairs of word and token that are sent to every task at most (some 60 bytes each); more are joined by a shuffle.
SENT = 1_000_000


def words_of(text: Column) -> Column:
    return F.split(T.normalize(text), " ")


def occurrences(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """word, t, n: how often each token occurs in each word that holds it (not overlapping, from the left), for distinct
    words (word) and tokens (t) of three letters or more."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substring("word", i, GRAM))
    cut = words.where(F.length("word") >= GRAM).select("word", F.explode(F.array_distinct(grams)).alias("gram"))
    # of a token's runs, one is enough: its last, as endings differ more than beginnings
    keyed = tokens.select("t").distinct().withColumn("gram", F.substring("t", -GRAM, GRAM))
    hit = cut.join(keyed, "gram").where(F.contains("word", "t"))
    return hit.select("word", "t", ((F.length("word") - F.length(F.replace("word", "t", F.lit("")))) / F.length("t")).cast("int").alias("n"))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("packet", "question", F.explode(review.question_tokens(F.col("text"))).alias("t"))


def top_pages(questions: DataFrame, pages: DataFrame, evidence: DataFrame, k: int = PAGES, sent: int = SENT) -> DataFrame:
    """packet, question, page, score, rank: the k best pages of each question's packet, page number on ties.

    A page that is not blank scores, for each token of the question, its occurrences in hint and text (MOST_HITS at
    most; twice for a token of over LONG_TOKEN letters), EVIDENCE for each evidence on the page that holds the token,
    MENTIONED if the question names the page, and UNSEEN if the page still needs visual review. Pages without a hit fill
    up. questions: packet, question, text; pages: packet, page, hint, text, blank, unseen; evidence: packet, page, id,
    kind, number, quote.

    A page without any hit can only be chosen if it is among its packet's k best before any question, so k pages a
    question, those named and those hit are all there is to rank."""
    c = F.col
    asked, seen = _asked(questions), pages.where(~F.coalesce("blank", F.lit(False)))
    base = F.when(F.coalesce("unseen", F.lit(False)), UNSEEN).otherwise(0)
    word = lambda df, keys, text: df.select(*keys, F.explode(words_of(text)).alias("word")).where(F.length("word") >= GRAM)
    in_pages = word(seen, ["packet", "page"], F.concat_ws(" ", "hint", "text"))
    in_evidence = word(evidence, ["packet", "page", "id"], F.concat_ws(" ", "kind", "number", "quote")).distinct()
    vocabulary = in_pages.select("word").union(in_evidence.select("word")).distinct()
    pairs = occurrences(vocabulary, asked)
    if pairs.limit(sent + 1).count() <= sent:  # words meet tokens where they are, and only hits move
        pairs, times = F.broadcast(pairs), F.lit(1)
    else:
        in_pages, times = in_pages.groupBy("packet", "page", "word").agg(F.count("*").alias("times")), c("times")
    hits = in_pages.join(pairs, "word").groupBy("packet", "page", "t").agg(F.sum(times * c("n")).alias("hits"))
    points = F.least(c("hits"), F.lit(MOST_HITS)) * F.when(F.length("t") > LONG_TOKEN, 2).otherwise(1)
    backed = in_evidence.join(pairs.select("word", "t"), "word").select("packet", "page", "id", "t").distinct().join(seen.select("packet", "page"), ["packet", "page"], "left_semi")
    found = hits.select("packet", "page", "t", points.alias("p")).unionByName(backed.select("packet", "page", "t", F.lit(EVIDENCE).cast("bigint").alias("p")))
    scored = found.join(asked, ["packet", "t"]).groupBy("packet", "question", "page").agg(F.sum("p").alias("p"))
    named = questions.select("packet", "question", F.explode(review.page_mentions(F.col("text"))).alias("page"))
    named = named.join(seen.select("packet", "page"), ["packet", "page"], "left_semi").select("packet", "question", "page", F.lit(MENTIONED).cast("bigint").alias("p"))
    order = Window.partitionBy("packet").orderBy(base.desc(), "page")
    calm = seen.select("packet", "page", F.row_number().over(order).alias("n")).where(c("n") <= k)
    fill = questions.select("packet", "question").join(calm, "packet").select("packet", "question", "page", F.lit(0).cast("bigint").alias("p"))
    total = scored.unionByName(named).unionByName(fill).groupBy("packet", "question", "page").agg(F.sum("p").alias("p"))
    total = total.join(seen.select("packet", "page", base.alias("base")), ["packet", "page"]).select("packet", "question", "page", (c("p") + c("base")).alias("score"))
    best = Window.partitionBy("packet", "question").orderBy(F.desc("score"), "page")
    return total.withColumn("rank", F.row_number().over(best).cast("long")).where(c("rank") <= k)


def top_rows(questions: DataFrame, rows: DataFrame, k: int, fallback: int = 0) -> DataFrame:
    """packet, question, id, score, rank: the k rows of the question's packet that hold the most of its tokens, at least
    one, by pos on ties; where no row holds any, the packet's first `fallback` rows with score 0.
    questions: packet, question, text; rows: packet, id, pos, text."""
    c = F.col
    asked = _asked(questions)
    words = rows.select("packet", "id", F.explode(F.array_distinct(words_of(c("text")))).alias("word"))
    pairs = occurrences(words.select("word").distinct(), asked)
    held = words.join(pairs.select("word", "t"), "word").select("packet", "id", "t").distinct()
    scored = held.join(asked, ["packet", "t"]).groupBy("packet", "question", "id").agg(F.count("*").alias("score")).join(rows.select("packet", "id", "pos"), ["packet", "id"])
    best = Window.partitionBy("packet", "question").orderBy(F.desc("score"), "pos", "id")
    top = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(c("rank") <= k).select("packet", "question", "id", "score", "rank")
    if not fallback:
        return top
    first = rows.select("packet", "id", F.row_number().over(Window.partitionBy("packet").orderBy("pos", "id")).cast("long").alias("rank")).where(c("rank") <= fallback)
    none = questions.select("packet", "question").join(top, ["packet", "question"], "left_anti").join(first, "packet")
    return top.unionByName(none.select("packet", "question", "id", F.lit(0).cast("long").alias("score"), "rank"))


def citations(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """answer, page, quote, supported: whether the page that an answer cites is in its packet, is not blank and holds the
    quote (QUESTION_RATIO of its tokens). Each citation meets its own page alone. cited: packet, answer, page, quote; pages:
    packet, page, text, blank."""
    p = pages.where(~F.coalesce("blank", F.lit(False))).select("packet", "page", T.normalize(F.col("text")).alias("p"))
    out = cited.join(p, ["packet", "page"], "left")
    return out.select("answer", "page", "quote", F.coalesce(contained(F.col("quote"), F.col("p"), QUESTION_RATIO), F.lit(False)).alias("supported"))
