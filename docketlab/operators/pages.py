"""Page scans: classification, ledger aggregates, budgets, summary segments, shards, markup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T

MIN_CHARS, MIN_PACKET_CHARS, MIN_COVERAGE, BUDGET = 80, 2000, 0.9, 80
FRONT_PAGES, SEED_PAGES, MISSES = 8, 3, 2
SHARD_PAGES, SHARD_CHARS, SHARD_EXTRA, OVERLAP = 72, 220_000, 150, 2


def order_type(text: Column, candidates: list[tuple[str, str]], label: str = "(?i)\\b(?:search\\s*type|order\\s*type)\\s*[:\\-]?\\s*([^|]{0,80})") -> Column:
    """Order type named in a labelled field, else anywhere in the first 30,000 characters; null if none is."""
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def named(opening: Column) -> Column:
        found = lambda labelled: F.coalesce(*[F.when((labelled != "") & labelled.rlike(p), name) for name, p in candidates])
        return F.coalesce(once(F.regexp_extract(opening, label, 1), found), *[F.when(opening.rlike(p), name) for name, p in candidates])

    # the opening and the label are made once a text, however many candidates read them
    return once(F.substring(T.compact(text), 1, 30_000), named)


def ledger(pages: DataFrame) -> DataFrame:
    """Per packet: pages, characters, coverage and lists of pages. pages: packet, page, char_count."""
    readable = F.col("char_count") >= MIN_CHARS
    out = pages.groupBy("packet").agg(
        F.count("*").alias("page_count"),
        F.sum("char_count").alias("chars"),
        F.count_if(readable).alias("readable"),
        F.count_if(F.col("char_count") == 0).alias("blank"),
        F.array_sort(F.collect_list(F.when(~readable, F.col("page")))).alias("low_pages"),
    )
    coverage = F.col("readable") / F.col("page_count")
    return out.withColumn("coverage", F.round(coverage, 4)).withColumn("ready", (F.col("chars") >= MIN_PACKET_CHARS) & (coverage >= MIN_COVERAGE))


def recovery_budget(pages: DataFrame, min_chars: int = MIN_CHARS, budget: int = BUDGET) -> DataFrame:
    """Low-text pages of each packet in page order; the first `budget` may be recovered, the rest are skipped."""
    w = Window.partitionBy("packet").orderBy("page")
    low = pages.where(F.col("char_count") < min_chars).withColumn("turn", F.row_number().over(w))
    return low.withColumn("allowed", F.col("turn") <= budget)


def summary_segment(pages: DataFrame, seed: str, signals: list[str], divider: str) -> DataFrame:
    """Pages of the opening summary: from the first seed page (among the first SEED_PAGES of FRONT_PAGES) on,
    over pages with signals, through single misses between them, up to a divider or MISSES misses in a row.

    pages: packet, page, text. A run of misses is counted from the last hit, so no fold is needed."""
    front = pages.where(F.col("page") <= FRONT_PAGES)
    hit = (T.signal_score(F.col("text"), signals) > 0) | F.col("text").rlike(divider)
    order = Window.partitionBy("packet").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    front = front.withColumn("hit", hit).withColumn("div", F.col("text").rlike(divider))
    front = front.withColumn("seed", F.min(F.when(F.col("text").rlike(seed), F.col("page"))).over(Window.partitionBy("packet")))
    front = front.where((F.col("seed") <= SEED_PAGES) & (F.col("page") >= F.col("seed")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    front = front.withColumn("at", F.row_number().over(order)).withColumn("last", F.max(F.when(F.col("hit"), F.col("at"))).over(upto))
    front = front.withColumn("misses", F.col("at") - F.coalesce("last", F.lit(0)))
    front = front.withColumn("over", F.coalesce(F.max((F.col("div") | (F.col("misses") >= MISSES)).cast("int")).over(before), F.lit(0)))
    end = F.coalesce(F.max(F.when((F.col("over") == 0) & F.col("hit"), F.col("page"))).over(Window.partitionBy("packet")), F.col("seed"))
    return front.withColumn("end", end).where(F.col("page") <= F.col("end")).select("packet", "page")


def shards(pages: DataFrame, max_pages: int = SHARD_PAGES, max_chars: int = SHARD_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """packet, page, shard: pages packed in order; a shard closes before the page that would exceed a limit,
    and the next one starts with its last `overlap` pages. An ordered fold per packet: its pages' numbers and sizes, not
    its texts, are sorted by Spark and pass by one after the other, so that only the open shard is held."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packet, held, total, shard = None, [], 0, 0
        begun = False
        for b in batches:
            out = []
            for p, page, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or p != packet:
                    packet, held, total, shard, begun = p, [], 0, 0, True
                if held and (len(held) >= max_pages or (size is not None and total is not None and total + size > max_chars)):
                    shard += 1
                    held = held[max(0, len(held) - overlap) :]
                    total = None if any(s is None for _, s in held) else sum(s for _, s in held)
                    out += [(p, q, shard) for q, _ in held]
                held.append((page, size))
                total = None if total is None or size is None else total + size
                out.append((p, page, shard))
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.int32()), strict=True)], names=["packet", "page", "shard"])

    sized = pages.select("packet", F.col("page").cast("bigint").alias("page"), (F.col("char_count") + SHARD_EXTRA).cast("bigint").alias("size"))
    kind = sized.schema["packet"].dataType.simpleString()
    return sized.repartition("packet").sortWithinPartitions("packet", "page", "size").mapInArrow(packed, f"packet {kind}, page bigint, shard int")


def markup_text(html: Column) -> Column:
    """Text of markup: scripts, styles and comments out, tags to blanks."""
    bare = T.replaced(html, "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->")
    return T.trimmed(T.replaced(bare, "(?s)<[^>]*>"))


def serialized(pages: DataFrame, limit: int = 18_000) -> DataFrame:
    """packet, body: pages in order as '[Page n]' blocks parted by a blank line; empty pages are marked."""
    block = F.concat(F.format_string("[Page %d]\n", F.col("page").cast("int")), F.when(F.col("text") == "", "[UNREADABLE]").otherwise(F.substring("text", 1, limit)))
    return pages.groupBy("packet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))


def first_accepted(candidates: DataFrame, min_chars: int = 32, min_confidence: float = 0.5) -> DataFrame:
    """Per page the first provider's result that is long and sure enough. candidates: key, ord, chars, confidence."""
    fine = (F.col("chars") >= min_chars) & (F.col("confidence") >= min_confidence) & ~F.isnan("confidence")
    return candidates.groupBy("key").agg(F.min(F.when(fine, F.col("ord"))).alias("accepted"), F.count("*").alias("attempts"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per page the candidate of the highest score; the first one on a tie. candidates: key, ord, chars, signals, confidence."""
    score = F.round(F.col("confidence") + F.least(F.lit(0.12), F.col("chars") / 20_000) + F.least(F.lit(0.16), F.col("signals") * 0.012), 6)
    best = candidates.withColumn("score", score).groupBy("key").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select("key", (-F.col("b.o")).alias("ord"), F.col("b.score").alias("score"))
