"""Merging of duplicate extractions: majority values, best facts, instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T

TIE = 0.08


def majority(values: DataFrame) -> DataFrame:
    """key, value, n: the most frequent value in comparison form, by its first spelling; the longer one on a
    tie, then the earlier. values: key, value, pos. Missing values do not count."""
    norm = values.where(~T.is_missing(F.col("value"))).groupBy("key", T.upper_words(F.col("value")).alias("norm"))
    agg = norm.agg(F.count("*").alias("n"), F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    best = agg.groupBy("key").agg(F.max(F.struct("n", F.length("value").alias("len"), (-F.col("pos")).alias("early"), "value")).alias("b"))
    return best.select("key", "b.value", F.col("b.n").alias("n"))


def best_fact(facts: DataFrame, tie: float = TIE) -> DataFrame:
    """key, value, support: the value with the most evidence, then the highest confidence; undecided ('Needs
    review') where the runner-up has as much evidence and a confidence within `tie`.
    facts: key, value, evidence, confidence."""
    ranked = facts.where(~T.is_missing(F.col("value"))).groupBy("key", T.upper_words(F.col("value")).alias("norm"))
    ranked = ranked.agg(F.min("value").alias("value"), F.countDistinct("evidence").alias("support"), F.max("confidence").alias("conf"))
    w = Window.partitionBy("key").orderBy(F.col("support").desc(), F.col("conf").desc(), "norm")
    ranked = ranked.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead(F.struct("support", "conf")).over(w)).where("r = 1")
    close = F.coalesce((F.col("next.support") == F.col("support")) & (F.abs(F.col("next.conf") - F.col("conf")) < tie), F.lit(False))
    return ranked.select("key", F.when(close, T.NEEDS_REVIEW).otherwise(F.col("value")).alias("value"), "support")


def merge_rows(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key with the majority value of each field, by the rule of majority() (null where none is stated),
    and the group's size; a key of which all fields are missing is still a row.

    Rows move once, as they are; where they have arrived, fields, and one mark a row, are unpivoted, and equal values are
    counted in fixed-width buffers, so that comparison forms are made and sorted of distinct values only.
    rows: key, pos and the fields."""
    mark = F.struct(F.lit("").alias("f"), F.lit(None).cast("string").alias("v"))
    said = [F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields]
    long = rows.select(key, "pos", *fields).repartition(key).select(key, "pos", F.explode(F.array(mark, *said)).alias("x")).select(key, "pos", "x.f", "x.v")
    same = long.groupBy(key, "f", "v").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).withColumn("norm", T.upper_words(F.col("v")))
    votes = same.groupBy(key, "f", "norm").agg(F.sum("n").alias("n"), F.min(F.struct("pos", "v")).alias("first"))
    # missing values lose their vote here: a filter on the form would be pushed down to every row
    stated = (F.col("norm") != "") & ~F.col("norm").isin(*T.MISSING)
    vote = F.struct("n", F.length("first.v").alias("len"), (-F.col("first.pos")).alias("early"), F.col("first.v").alias("v"))
    return votes.groupBy(key).agg(*[F.max(F.when((F.col("f") == f) & stated, vote))["v"].alias(f) for f in fields], F.max(F.when(F.col("f") == "", F.col("n"))).alias("n"))


def union_by_identity(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per identity, with the distinct evidence of all of them, sorted. rows: ..., evidence (array)."""
    merged = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.min(order).alias(order))
    return merged


def fold_entries(rows: DataFrame) -> DataFrame:
    """packet, text, n: entries folded in order, each joining the first held one of the same key; an empty
    field of the held entry is filled from the joining one. rows: packet, pos, key, value. The fold is not
    associative, so it runs over each packet's entries in order."""
    item = F.struct("pos", "key", "value")
    start = F.array().cast("array<struct<pos:int,key:string,value:string>>")

    def add(held, e):
        known = F.exists(held, lambda x: x["key"] == e["key"])
        fill = F.transform(held, lambda x: F.when((x["key"] == e["key"]) & (x["value"] == ""), F.struct(x["pos"].alias("pos"), x["key"].alias("key"), e["value"].alias("value"))).otherwise(x))
        return F.when(known, fill).otherwise(F.concat(held, F.array(e)))

    packed = rows.select("packet", item.alias("e")).groupBy("packet").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return packed.select("packet", F.aggregate("es", start, add).alias("entries"))
