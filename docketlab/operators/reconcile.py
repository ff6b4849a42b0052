"""Reconciliation of a summary with its sources, in both directions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.functions import text as T


def type_mask(kind: Column) -> Column:
    """Bits of the type groups a document type is in."""
    mask = F.lit(0)
    for i, group in enumerate(D.TYPE_GROUPS):
        mask = mask + F.when(T.normalize(kind).rlike(group), 1 << i).otherwise(0)
    return mask


def type_compatible(a: Column, b: Column) -> Column:
    x, y = T.normalize(a), T.normalize(b)
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x) | (type_mask(a).bitwiseAND(type_mask(b)) != 0)


def party_overlap(expected: Column, names: Column, share: float = 0.6) -> Column:
    """At least `share` of the expected tokens (over two letters) occur in the names."""
    tokens = F.filter(F.split(T.normalize(expected), " "), lambda t: F.length(t) > 2)
    hits = F.size(F.filter(tokens, lambda t: F.contains(T.normalize(names), t)))
    return (F.size(tokens) == 0) | (hits >= share * F.size(tokens))


def matched(entries: DataFrame, sources: DataFrame, tolerance: Column) -> DataFrame:
    """Entries with their source by number: MATCHED, MISMATCHED or SOURCE_MISSING; of several sources of one number
    the one with the smallest amount, so that an entry gives one row. cascade.reconciled deals sources out one to one.
    entries: number, amount; sources: number, amount (decimals)."""
    s = sources.groupBy("number").agg(F.min("amount").alias("source_amount"))
    out = entries.join(s, "number", "left")
    status = F.when(F.col("source_amount").isNull(), "SOURCE_MISSING").when(tolerance, "MATCHED").otherwise("MISMATCHED")
    return out.withColumn("status", status)


def greedy(entries: DataFrame, sources: DataFrame, gap: float) -> DataFrame:
    """packet, entry, source: entries in order each take the nearest source left whose amount is off by at most
    `gap` of the entry's (the first of equally near ones); a source serves one entry. Each packet is folded in
    order inside aggregate(), over ids and amounts alone. entries: packet, entry, amount; sources: packet, source,
    amount (decimals)."""
    share = F.lit(Decimal(str(gap)))
    packed = lambda df, key: df.groupBy("packet").agg(F.array_sort(F.collect_list(F.struct(key, "amount"))).alias(key))
    both = packed(entries, "entry").join(packed(sources, "source"), "packet", "left")
    pool = F.coalesce("source", F.array().cast(both.schema["source"].dataType))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<entry:bigint,source:bigint>>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        off = lambda s: F.abs(s["amount"] - e["amount"])
        near = F.filter(pool, lambda s: ~F.array_contains(state["used"], s["source"]) & (off(s) <= share * F.abs(e["amount"])))
        pick = F.array_min(F.transform(near, lambda s: F.struct(off(s).alias("off"), s["source"].alias("source"))))["source"]
        used = F.when(pick.isNotNull(), F.concat(state["used"], F.array(pick))).otherwise(state["used"])
        return F.struct(used.alias("used"), F.concat(state["out"], F.array(F.struct(e["entry"].cast("long").alias("entry"), pick.alias("source")))).alias("out"))

    return both.select("packet", F.explode(F.aggregate("entry", start, step, lambda s: s["out"])).alias("p")).select("packet", "p.*")


def omitted(sources: DataFrame, entries: DataFrame, on: str) -> DataFrame:
    """Sources that no entry names."""
    return sources.join(entries.select(on).distinct(), on, "left_anti")


def counts(reconciled: DataFrame, by: str) -> DataFrame:
    return reconciled.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("MATCHED", "matched"), ("MISMATCHED", "mismatched"), ("SOURCE_MISSING", "missing"))])


def releases(liens: DataFrame, events: DataFrame) -> DataFrame:
    """packet, lien, release, via: by referenced number, by own number, or by the number inside the release's
    text; three joins rather than one with OR. liens: packet, lien, number; events: packet, release, number,
    refers, text."""
    one = liens.join(events, (liens["packet"] == events["packet"]) & (liens["number"] == events["refers"])).select(liens["packet"], "lien", "release", F.lit("REFERENCE").alias("via"))
    two = liens.join(events, (liens["packet"] == events["packet"]) & (liens["number"] == events["number"])).select(liens["packet"], "lien", "release", F.lit("NUMBER").alias("via"))
    three = liens.join(events, (liens["packet"] == events["packet"]) & F.contains(events["text"], liens["number"])).select(liens["packet"], "lien", "release", F.lit("TEXT").alias("via"))
    return one.union(two).union(three).groupBy("packet", "lien", "release").agg(F.min("via").alias("via"))


def chain(deeds: DataFrame) -> DataFrame:
    """packet, deed, continues: whether each deed's grantees meet the next one's grantors; null for the last
    deed and where either side is empty. deeds: packet, deed, dated, grantees, grantors (arrays)."""
    w = Window.partitionBy("packet").orderBy(F.col("dated").asc_nulls_last(), "deed")
    nxt = deeds.withColumn("next", F.lead("grantors").over(w))
    known = (F.size("grantees") > 0) & (F.size("next") > 0)
    return nxt.select("packet", "deed", F.when(F.col("next").isNotNull() & known, F.arrays_overlap("grantees", "next")).alias("continues"))


def chain_of_packet(links: DataFrame) -> DataFrame:
    return links.groupBy("packet").agg(F.bool_and("continues").alias("continuous"))


