"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. Token sums per source and hash bucket give, for each
source, the bucket where the budget is reached; only that bucket is opened, by further bits of the hash, and
only the last sub-bucket is read document by document. Selecting is then one comparison of a document's hash
with its source's threshold: nothing is sorted over a whole source, and no key meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = "[^\\x20\\x09-\\x0D]+"
BITS, LEVEL = 60, 10
CAP = 3


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of MD5 over the id's text; a null id counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target: shares of all words by weight 1, 2, 3, 1, ... in code point order, null
    last; no target above cap times its source's size, what is over being shared by weight among the rest.

    A target is least(cap * size, level * weight) for the one level at which targets sum to all words: with
    sources in order of cap * size / weight, the first k are at their caps and the level follows from sums.
    The windows below run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    per = per.withColumn("roof", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy(F.col("roof") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("roof").over(order), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("fits", F.col("level") <= F.col("roof") / F.col("weight"))
        .withColumn("level", F.coalesce(F.max(F.when(F.col("fits"), F.struct(F.col("open").alias("o"), F.col("level").alias("v")))).over(everything)["v"], F.lit(0.0)))
    )
    return per.select("source", "source_size", F.least(F.col("roof"), F.col("level") * F.col("weight")).alias("target"))


def _boundary(rows: DataFrame, left: DataFrame, bucket: Column) -> DataFrame:
    """left: source, need. The bucket of each source where its running sum first reaches need, and what is
    still needed inside it. At most 2**LEVEL rows a source reach the window."""
    due = left.select(F.col("source").alias("s"), F.col("need").alias("due"))
    sums = rows.select("source", "size", bucket.alias("bucket")).groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.join(due, sums["source"].eqNullSafe(due["s"])).select("source", "bucket", "sum", F.col("due").alias("need"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(w), F.lit(0)))
    hit = sums.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("sum") >= F.col("need")))
    return hit.select("source", "bucket", (F.col("need") - F.col("before")).alias("need"))


def thresholds(sizes: DataFrame, targets: DataFrame, levels: int = 2) -> DataFrame:
    """source, passes, below: each document is taken `passes` times, and once more if its hash is < below.

    The rest of a budget after whole passes is filled in hash order; the document that crosses it is taken
    only if that ends nearer to the budget. Equal hashes (repeated ids) go together.
    """
    targets = stored(targets, "targets")
    base = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    base = base.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    left, rows, shift = base.where("rest > 0").select("source", F.col("rest").alias("need")), sizes.where("size > 0"), BITS
    for _ in range(levels):
        shift -= LEVEL
        left = _boundary(rows, left, F.shiftright("hash", shift))
        left = stored(left, "edge")  # one row a source
        edge = left.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
        rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift) == F.col("b"))).drop("s", "b")
        left = left.drop("bucket")
    last = rows.groupBy("source", "hash").agg(F.sum("size").alias("size"))
    n = left.select(F.col("source").alias("s"), "need")
    last = last.join(n, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    w = Window.partitionBy("source").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    last = last.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("size") >= F.col("need")))
    over = F.col("before") + F.col("size") - F.col("need")
    cut = last.select(F.col("source").alias("s"), F.when(over <= F.col("need") - F.col("before"), F.col("hash") + 1).otherwise(F.col("hash")).alias("below"))
    out = base.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return out.withColumn("below", F.coalesce("below", F.lit(0)))


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and hash of every row, stored: the one pass over the texts."""
    out = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash60(F.col("doc_id")).alias("hash"))
    return stored(out, "sizes")


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row for every row of docs.

    Null texts have size 0 and are taken 0 words; rows of a null source form the last source; a null id
    hashes as ''. Rows that repeat an id are decided alike. An empty table gives an empty result. Columns of
    docs other than doc_id, text and source are not read.
    """
    sizes = document_sizes(docs)
    cut = stored(thresholds(sizes, source_targets(sizes, cap)), "cuts").withColumnRenamed("source", "s")
    joined = sizes.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    copies = F.col("passes") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return joined.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "hash")


def mixed_documents(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The mix itself: rows of docs, each repeated as often as it is taken (0 to cap times). Rows without
    words weigh nothing either way and are kept once. Thresholds are joined to rows, so texts never shuffle."""
    sizes = document_sizes(docs)
    cut = stored(thresholds(sizes, source_targets(sizes, cap)), "cuts").select(F.col("source").alias("s"), "passes", "below")
    names = docs.columns
    # the caller's columns travel as one, so that none meets a column of this function
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("own"), hash60(F.col("doc_id")).alias("hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("size"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("passes") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))
    out = rows.join(cut, F.col("own").eqNullSafe(F.col("s")), "left").select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])
