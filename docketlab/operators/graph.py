"""Evidence graph, retrieval for questions, export and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.functions import text as T
from docketlab.operators import review

#: Pages whose token counts one task holds, for all questions.
PAGES_A_TASK = 5_000
#: Tokens of questions that are sent to every task at most; more are joined by a shuffle.
TOKENS_SENT = 1_000_000


def upserted(nodes: DataFrame) -> DataFrame:
    """One row per node id: the first type and label, all evidence ids sorted and distinct. nodes: id, type, label, pos, evidence."""
    return nodes.groupBy("id").agg(F.min_by("type", "pos").alias("type"), F.min_by("label", "pos").alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def edges(links: DataFrame) -> DataFrame:
    """Distinct edges with content-hash ids. links: src, dst, type."""
    return links.distinct().withColumn("id", T.digest("edge_", F.concat_ws("|", "src", "type", "dst")))


def neighbours(seeds: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """seed, other: up to `most` endpoints of each seed's edges, either way round, in id order."""
    out = seeds.join(links, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("other"))
    back = seeds.join(links, F.col("seed") == F.col("dst")).select("seed", F.col("src").alias("other"))
    w = Window.partitionBy("seed").orderBy("other")
    return out.union(back).distinct().withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= most)


def top_pages(questions: DataFrame, pages: DataFrame, k: int = 12, most_hits: int = 5, long_token: int = 7) -> DataFrame:
    """question, page, score, rank: the k pages with the most token hits for each question.

    A token counts at most `most_hits` times, and twice if longer than `long_token`. Questions' tokens, without stop
    words, meet the pages' words, counted page by page, in an equi join; retrieval.top_pages has the whole score.
    Words that are tokens move once, by page, to as many tasks as pages call for: all counts of a page are made there.
    questions: question, text; pages: page, text."""
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, pages.count() // PAGES_A_TASK + 1)
    tokens = questions.select("question", F.explode(review.question_tokens(F.col("text"))).alias("t"))
    tokens = F.broadcast(tokens) if tokens.limit(TOKENS_SENT + 1).count() <= TOKENS_SENT else tokens
    words = pages.select("page", F.explode(F.split(T.normalize(F.col("text")), " ")).alias("t")).where(F.length("t") > 2)
    hits = words.join(tokens.select("t"), "t", "left_semi").repartition(parts, "page").groupBy("page", "t").agg(F.count("*").alias("n"))
    score = F.sum(F.least(F.col("n"), F.lit(most_hits)) * F.when(F.length("t") > long_token, 2).otherwise(1)).cast("long")
    scored = hits.join(tokens, "t").groupBy("question", "page").agg(score.alias("score"))
    w = Window.partitionBy("question").orderBy(F.col("score").desc(), "page")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def verified_citations(citations: DataFrame, grounded: DataFrame) -> DataFrame:
    """Citations whose quote their page grounds. citations: quote_id, page_id."""
    return citations.join(grounded.select("quote_id", "page_id"), ["quote_id", "page_id"], "left_semi")


def illegal_steps(log: DataFrame) -> DataFrame:
    """key, seq, stage, before: steps that do not follow the one before them. log: key, seq, stage."""
    order = F.create_map(*[x for i, s in enumerate(D.STAGES) for x in (F.lit(s), F.lit(i))])
    w = Window.partitionBy("key").orderBy("seq")
    log = log.withColumn("before", F.coalesce(F.lag("stage").over(w), F.lit(D.STAGES[0])))
    legal = (F.try_element_at(order, F.col("stage")) == F.try_element_at(order, F.col("before")) + 1) | ((F.col("stage") == "FAILED") & ~F.col("before").isin("COMPLETE", "FAILED"))
    return log.where(~F.coalesce(legal, F.lit(False)))


def export_lines(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One quoted CSV line per row."""
    return rows.select("key", T.csv_line(list(columns.values())).alias("line"))


def export_warnings(rows: DataFrame, required: dict[str, Column]) -> DataFrame:
    """key, field, message for each required field that is missing: rows times fields by one explode."""
    long = rows.select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in required.items()])).alias("x")).select("key", "x.*")
    return long.where(T.is_missing(F.col("value"))).select("key", "field", F.concat(F.lit("required field "), "field", F.lit(" is unresolved")).alias("message"))


def identity_keys(rows: DataFrame) -> DataFrame:
    """key, kind, identity: opaque, client-scoped hashes of order, parcel and address; of the packet where
    there is none. rows: key, client, order_number, parcel, address, packet."""
    scope = F.when(T.upper_words(F.col("client")) == "", "UNSCOPED").otherwise(T.upper_words(F.col("client")))
    parts = F.filter(F.array(*[F.when(~T.is_missing(F.col(c)), F.struct(F.lit(k).alias("kind"), T.upper_words(F.col(c)).alias("value"))) for k, c in (("order", "order_number"), ("parcel", "parcel"), ("address", "address"))]), lambda x: x.isNotNull())
    parts = F.when(F.size(parts) == 0, F.array(F.struct(F.lit("packet").alias("kind"), F.col("packet").alias("value")))).otherwise(parts)
    out = rows.select("key", scope.alias("scope"), F.explode(parts).alias("x"))
    return out.select("key", "x.kind", F.concat(F.col("x.kind"), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", "scope", "x.kind", "x.value"), 256), 1, 32)).alias("identity"))


def revisions(reviews: DataFrame) -> DataFrame:
    """matter, review, revision: one more than the earlier distinct reviews of the matter. reviews: matter, review, at."""
    first = reviews.groupBy("matter", "review").agg(F.min("at").alias("at"))
    w = Window.partitionBy("matter").orderBy("at", "review")
    return first.select("matter", "review", F.row_number().over(w).cast("long").alias("revision"))
