"""Stores probed by hashed keys: the identity index and dossiers. Rows lie in partitions by the key's first letters, so a
probe reads only the partitions of its own keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a key's hash that name its partition: 16 ** LETTERS partitions at most, however many keys there are.
LETTERS = 2


def shelf(key: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, LETTERS)


def put(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows under their key. Written shelf by shelf, so that a task writes few files."""
    marked = rows.withColumn("shelf", shelf(F.col(key)))
    marked.repartition("shelf", key).sortWithinPartitions("shelf").write.mode("append").partitionBy("shelf").parquet(path)


def take(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is among keys (column `key`): the shelves that keys lie in, 16 ** LETTERS at most, become a
    filter of partitions, and the keys themselves a semi join. No keys give no rows."""
    asked = keys.select(key).distinct()
    shelves = [r[0] for r in asked.select(shelf(F.col(key))).distinct().collect()]  # bounded by the letters
    return spark.read.parquet(path).where(F.col("shelf").isin(shelves)).join(asked, key, "left_semi").drop("shelf")


def indexed_reviews(spark: SparkSession, path: str, identities: DataFrame) -> DataFrame:
    """key, revision: one more than the distinct reviews that the index holds under any identity of a key.
    identities: key, identity; the index (put with key identity): identity, review."""
    held = take(spark, path, identities, "identity").select("identity", "review").distinct()
    found = identities.select("key", "identity").distinct().join(held, "identity", "left")
    return found.groupBy("key").agg((F.countDistinct("review") + 1).alias("revision"))


def dossiers(spark: SparkSession, path: str, reviews: DataFrame) -> DataFrame:
    """The last dossier (by at) of each review asked for; reviews without one are absent. reviews: review; the store (put
    with key review): review, at, and what a dossier holds."""
    from docketlab.operators.checks import latest

    return latest(take(spark, path, reviews, "review"), ["review"], [F.col("at").desc()])
