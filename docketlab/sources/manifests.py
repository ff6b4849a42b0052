"""Batch manifests as an append-only log of creations and patches; the state of an item is its replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a patch may set, and what an item begins as. A patch of anything else is ignored.
FIELDS = ["status", "review", "packet_hash", "error"]
QUEUED, CLIENT = "QUEUED", "Client"
#: A log row: version is the version of the item that its writer had read (0 for a creation); id tells rows of one time apart.
LOG = "batch string, item string, at timestamp, id string, version long, source_file string, client string, profile string, fields map<string,string>"


def created(batches: DataFrame) -> DataFrame:
    """Log rows of new batches, one an item: ids are hashes of batch, place and file, so that a creation that ran twice
    is one. batches: batch, client, profile, at, files (array). A blank client is named 'Client'."""
    client = F.coalesce(F.nullif(F.trim("client"), F.lit("")), F.lit(CLIENT))
    rows = batches.select(F.col("batch").cast("string").alias("batch"), client.alias("client"), "profile", "at", F.posexplode("files").alias("i", "source_file"))
    item = F.sha2(F.concat_ws("|", "batch", F.col("i").cast("string"), "source_file"), 256)
    return rows.select("batch", item.alias("item"), "at", item.alias("id"), F.lit(0).cast("long").alias("version"), "source_file", "client", "profile", F.create_map(F.lit("status"), F.lit(QUEUED)).alias("fields"))


def patched(patches: DataFrame) -> DataFrame:
    """Log rows of patches: batch, item, at, id, version, fields."""
    none = F.lit(None).cast("string")
    return patches.select(F.col("batch").cast("string").alias("batch"), "item", "at", "id", F.col("version").cast("long").alias("version"), *[none.alias(c) for c in ("source_file", "client", "profile")], "fields")


def _is_creation() -> Column:
    return F.col("source_file").isNotNull()


def items(log: DataFrame) -> DataFrame:
    """One row a created item: each field as the last row that sets it left it (by time, then id), updated (its last
    row's time), version (how many patches it has) and stale, how many of these were written by one who had not read all
    rows before them. Rows that repeat count once. Patches of one time and item that set different fields all stay; the
    order of the log's files does not matter, so concurrent writers replay to one state."""
    c = F.col
    first = ~_is_creation()
    before = Window.partitionBy("batch", "item").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.dropDuplicates(["batch", "item", "id"]).withColumn("earlier", F.count_if(first).over(before))
    turn = F.struct(first.alias("patch"), c("at").alias("at"), c("id").alias("id"))
    last = lambda f: F.max_by(c("fields")[f], F.when(F.map_contains_key("fields", f), turn)).alias(f)
    made = lambda name: F.max(F.when(_is_creation(), c(name)))
    out = rows.groupBy("batch", "item").agg(made("source_file").alias("source_file"), made("client").alias("client"), made("profile").alias("profile"), made("at").alias("created"), *[last(f) for f in FIELDS], F.max("at").alias("updated"), F.count_if(first).alias("version"), F.count_if(first & (c("version") < c("earlier"))).alias("stale"))
    return out.where("source_file is not null")


def manifests(log: DataFrame) -> DataFrame:
    """One row a batch: client, profile, created, updated, and how many items it has in all and by status."""
    at = items(log)
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return at.groupBy("batch").agg(F.max("client").alias("client"), F.max("profile").alias("profile"), F.min("created").alias("created"), F.max("updated").alias("updated"), F.count("*").alias("items"), *[count(s) for s in (QUEUED, "PROCESSING", "COMPLETE", "ERROR")])


def refused(log: DataFrame) -> DataFrame:
    """batch, item, id, reason of patches whose batch or item was never created."""
    made = log.where(_is_creation()).select("batch", "item").distinct()
    batches = made.select("batch").distinct().withColumn("known", F.lit(True))
    lost = log.where(~_is_creation()).join(made, ["batch", "item"], "left_anti").join(batches, "batch", "left")
    return lost.select("batch", "item", "id", F.when(F.col("known"), "Batch item was not found.").otherwise("Batch manifest was not found.").alias("reason"))


def compacted(log: DataFrame) -> DataFrame:
    """A log of the same state with two rows an item at most: its creation, and one patch with all fields
    (null where none was set, or was set to null). Versions are lost, as every reader of the compacted log has read all of it."""
    rows = items(log)
    none, fields = F.lit(None).cast("string"), [x for f in FIELDS for x in (F.lit(f), F.col(f))]
    base = rows.select("batch", "item", F.col("created").alias("at"), F.col("item").alias("id"), F.lit(0).cast("long").alias("version"), "source_file", "client", "profile", F.create_map(F.lit("status"), F.lit(QUEUED)).alias("fields"))
    patch = rows.where("version > 0").select("batch", "item", F.col("updated").alias("at"), F.concat(F.lit("compacted-"), "item").alias("id"), F.lit(0).cast("long").alias("version"), none.alias("source_file"), none.alias("client"), none.alias("profile"), F.create_map(*fields).alias("fields"))
    return base.unionByName(patch)
