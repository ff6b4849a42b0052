"""Queries of batch manifests over customers as items and events as their patches, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.sources import manifests as M


def _log(spark, d):
    at = F.to_timestamp(F.lit("2000-01-01"))
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    files = users.where("user_id % 11 > 0").groupBy((F.col("user_id") % 30).alias("batch")).agg(F.array_sort(F.collect_list(F.col("user_id").cast("string"))).alias("files"))
    made = M.created(files.select("batch", F.when(F.col("batch") % 2 == 0, F.concat(F.lit("Client "), "batch")).otherwise(" ").alias("client"), F.lit("default").alias("profile"), at.alias("at"), "files"))
    # patches name items by their file here; the log names them by id
    ids = made.select("batch", "item", F.col("source_file").alias("file"))
    e = spark.read.parquet(f"{d}/events.parquet")
    user = F.col("user_id").cast("string")
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "COMPLETE").otherwise("PROCESSING")
    empty = F.create_map().cast("map<string,string>")
    fields = F.map_concat(F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("status"), status)).otherwise(empty), F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("review"), F.concat(F.lit("r"), F.col("event_id").cast("string")))).otherwise(empty), F.when(F.col("event_id") % 7 == 0, F.create_map(F.lit("other"), F.lit("x"))).otherwise(empty))
    patches = e.select((F.col("user_id") % 30).cast("string").alias("batch"), user.alias("file"), F.col("ts").alias("at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), (F.col("event_id") % 4).alias("version"), fields.alias("fields"))
    patches = patches.join(ids, ["batch", "file"], "left").withColumn("item", F.coalesce("item", "file"))
    return made.unionByName(M.patched(patches))


def manifest_items(spark, d):
    out = M.items(_log(spark, d))
    return out.select("batch", "source_file", "client", "status", "review", "packet_hash", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"), "version", F.col("stale").cast("long").alias("stale"))


def manifest_batches(spark, d):
    return M.manifests(_log(spark, d)).select("batch", "client", "items", "queued", "processing", "complete", "error")


def manifest_refused(spark, d):
    return M.refused(_log(spark, d)).groupBy("batch", "reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (manifest_items, manifest_batches, manifest_refused)}

_E = """e as (select *, user_id%30 batch, row_number() over (partition by user_id order by ts, lpad(event_id::varchar,12,'0')) - 1 turn, case when event_id%3>0 then case event_type when 'error' then 'ERROR' when 'purchase' then 'COMPLETE' else 'PROCESSING' end end status, case when event_id%5=0 then 'r'||event_id end review from events),
 i as (select user_id, any_value(batch)::varchar batch, coalesce(arg_max(status, (ts, lpad(event_id::varchar,12,'0'))) filter (status is not null),'QUEUED') status, arg_max(review, (ts, lpad(event_id::varchar,12,'0'))) filter (review is not null) review, max(ts) updated, count(*) as version, count(*) filter (event_id%4<turn) stale from e where user_id%11>0 group by 1)"""
_CLIENT = "case when batch::int%2=0 then 'Client '||batch else 'Client' end client"
ORACLES = {
    "manifest_items": f"with {_E} select batch, user_id::varchar source_file, {_CLIENT}, status, review, null::varchar packet_hash, strftime(updated,'%Y-%m-%d %H:%M:%S') updated, version, stale from i",
    "manifest_batches": f"with {_E} select batch, {_CLIENT}, count(*) items, count(*) filter (status='QUEUED') queued, count(*) filter (status='PROCESSING') processing, count(*) filter (status='COMPLETE') complete, count(*) filter (status='ERROR') error from i group by 1,2",
    "manifest_refused": f"with {_E} select e.batch::varchar batch, case when exists (select 1 from i where i.batch=e.batch::varchar) then 'Batch item was not found.' else 'Batch manifest was not found.' end reason, count(*) n from e where user_id%11=0 group by 1,2",
}
