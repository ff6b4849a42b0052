"""Summary entries matched to source instruments one to one, and everything that follows from the match.

Entries take their turn in order. Each takes, of the sources no earlier entry has used: the first of its number;
else the first of its book and page whose type is compatible; else the only source of a compatible type that is
left. What an entry takes hangs on all entries before it, so a packet is folded in order; the fold runs inside
aggregate() over keys alone (numbers, type bits), and the fields that are compared join its result afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlab.functions import text as T
from docketlab.operators.reconcile import type_mask

MATCH, MISMATCH, MISSING = "MATCH", "MISMATCH", "SOURCE_MISSING"
#: Types a summary is expected to list, types it is not, and words that are no part of a legal text.
EXPECTED = "(?i)deed|mortgage|deed of trust|security deed|assignment|release|satisfaction|reconveyance|judgment|lien|trustee|foreclosure"
NOT_EXPECTED = "(?i)assessor|tax bill|pacer|bankrupt"
PARTY_SHARE = 0.6

#: Fields of an entry and of a source that are compared, by name and key.
ENTRY = "packet, entry, ord, number, book_page, kind, documented, recorded, amount, parties, legal, evidence (array)"
SOURCE = "packet, source, pos, number, book_page, kind, documented, recorded, amount, parties (array of names), legal, evidence (array)"


def cleaned(col: Column) -> Column:
    """The text without outer blanks; '' where it is missing or says that it needs review."""
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    return F.when(F.lower(text) == T.NEEDS_REVIEW.lower(), "").otherwise(text)


def letters_key(col: Column) -> Column:
    return T.replaced(F.lower(cleaned(col)), "[^a-z0-9]", "")


def words_key(col: Column) -> Column:
    return T.normalize(cleaned(col))


def legal_words(col: Column) -> Column:
    """Comparison form of a legal description: its words without 'the'."""
    return F.trim(T.replaced(T.replaced(words_key(col), "\\bthe\\b", ""), "\\s+"))


def day_key(col: Column) -> Column:
    """ISO date of m/d/y, ISO or written-out dates; other text in comparison form."""
    text = cleaned(col)
    # only text with letters can name a month; a text that fails to parse costs an exception each
    written = F.when(text.rlike("\\p{L}"), F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")]))
    return F.coalesce(F.date_format(written, "yyyy-MM-dd"), T.date_key(text))


def money_words(col: Column) -> Column:
    return T.money_key(cleaned(col))


def parties_meet(expected: Column, names: Column) -> Column:
    """At least PARTY_SHARE of the expected tokens of over two letters occur in the source's names, letters in any
    place. Nothing expected always meets; no names meet nothing else."""
    want, have = words_key(expected), T.normalize(F.array_join(names, " "))
    tokens = F.filter(F.split(want, " "), lambda t: F.length(t) > 2)
    hits = F.size(F.filter(tokens, lambda t: F.contains(have, t)))
    return (want == "") | ((have != "") & ((F.size(tokens) == 0) | (hits >= PARTY_SHARE * F.size(tokens))))


def _keys() -> Column:
    c = F.col
    return F.struct(letters_key(c("number")).alias("n"), letters_key(c("book_page")).alias("b"), words_key(c("kind")).alias("k"), type_mask(cleaned(c("kind"))).alias("m"), (F.size("evidence") > 0).alias("e"))


def compatible(a: Column, b: Column) -> Column:
    """Over key structs: either type is missing, holds the other, or both are of one type group."""
    x, y = a["k"], b["k"]
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x) | (a["m"].bitwiseAND(b["m"]) != 0)


def picks(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """packet, ord, pos, tier of every entry that takes a source (tier 1, 2 or 3), by the cascade above. A taken
    source is used up only if both sides have evidence. Rows of one ord or pos are kept apart by entry and source.

    One row a packet holds the keys of its entries and sources (some 60 bytes each), no texts."""
    packed = lambda df, *order: df.groupBy("packet").agg(F.array_sort(F.collect_list(F.struct(*order, _keys().alias("key")))).alias(order[-1]))
    numbered = lambda rows: F.transform(rows, lambda x, i: x["key"].withField("i", i.cast("long")))
    both = packed(entries, "ord", "entry").join(packed(sources, "pos", "source"), "packet").withColumn("keys", numbered("source"))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<e:bigint,s:bigint,tier:int>>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        left = F.filter("keys", lambda s: ~F.array_contains(state["used"], s["i"]))
        one = F.get(F.filter(left, lambda s: (e["n"] != "") & (s["n"] == e["n"])), F.lit(0))
        two = F.get(F.filter(left, lambda s: (e["b"] != "") & (s["b"] == e["b"]) & compatible(e, s)), F.lit(0))
        fit = F.filter(left, lambda s: compatible(e, s))
        three = F.when(F.size(fit) == 1, F.get(fit, F.lit(0)))
        found = F.coalesce(one, two, three)
        tier = F.when(one.isNotNull(), 1).when(two.isNotNull(), 2).otherwise(3)
        used = F.when(found.isNotNull() & e["e"] & found["e"], F.concat(state["used"], F.array(found["i"]))).otherwise(state["used"])
        out = F.when(found.isNotNull(), F.concat(state["out"], F.array(F.struct(e["i"].alias("e"), found["i"].alias("s"), tier.alias("tier"))))).otherwise(state["out"])
        return F.struct(used.alias("used"), out.alias("out"))

    folded = both.select("packet", "entry", "source", F.explode(F.aggregate(numbered("entry"), start, step, lambda s: s["out"])).alias("p"))
    at = lambda rows, i: F.get(F.col(rows), i.cast("int"))
    e, s = at("entry", F.col("p.e")), at("source", F.col("p.s"))
    return folded.select("packet", e["ord"].alias("ord"), e["entry"].alias("entry"), s["pos"].alias("pos"), s["source"].alias("source"), "p.tier")


#: Field name, column of the entry, column of the source, key of both.
COMPARED = [
    ("Instrument Number", "number", letters_key),
    ("Book/Page", "book_page", letters_key),
    ("Document Date", "documented", day_key),
    ("Recording Date", "recorded", day_key),
    ("Amount", "amount", money_words),
]


def mismatches() -> Column:
    """Fields of the row (entry's columns, and the source's with s_) whose keys differ, in their fixed order; a field
    that either side leaves out is not compared."""
    c, found = F.col, []
    for name, field, key in COMPARED:
        both = (cleaned(c(field)) != "") & (cleaned(c(f"s_{field}")) != "")
        found.append(F.when(both & (key(c(field)) != key(c(f"s_{field}"))), name))
    found.append(F.when((cleaned(c("parties")) != "") & ~parties_meet(c("parties"), c("s_parties")), "Parties"))
    a, b = legal_words(c("legal")), legal_words(c("s_legal"))
    found.append(F.when((a != "") & (b != "") & (a != b), "Legal Description"))
    return F.array_compact(F.array(*found))


def expected(kind: Column) -> Column:
    """Whether a summary is expected to list a source of this type."""
    return F.coalesce(kind.rlike(EXPECTED) & ~kind.rlike(NOT_EXPECTED), F.lit(False))


def reconciled(entries: DataFrame, sources: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """packet, entry, source, tier, status, fields (that mismatch) and evidence (the entry's, then the source's, each
    once) of every entry: SOURCE_MISSING where no source is taken or either side has no evidence. also: further columns,
    over the entry's columns and the source's with s_."""
    s = sources.select("packet", "source", *[F.col(n).alias(f"s_{n}") for n in ("number", "book_page", "kind", "documented", "recorded", "amount", "parties", "legal", "evidence")])
    out = entries.join(picks(entries, sources).drop("ord", "pos"), ["packet", "entry"], "left").join(s, ["packet", "source"], "left")
    none = F.array().cast("array<string>")
    supported = F.col("source").isNotNull() & (F.size("evidence") > 0) & (F.size("s_evidence") > 0)
    fields = F.when(supported, mismatches()).otherwise(none)
    status = F.when(~supported, MISSING).when(F.size(fields) > 0, MISMATCH).otherwise(MATCH)
    evidence = F.array_distinct(F.concat(F.coalesce("evidence", none), F.coalesce("s_evidence", none)))
    return out.select("packet", "entry", "ord", "source", "tier", status.alias("status"), fields.alias("fields"), evidence.alias("evidence"), *[v.alias(k) for k, v in (also or {}).items()])


def unlisted(sources: DataFrame, matched: DataFrame) -> DataFrame:
    """Sources of a type that a summary lists, taken by no entry (a source taken without evidence counts as taken)."""
    return sources.where(expected(F.col("kind"))).join(matched.where("source is not null").select("packet", "source").distinct(), ["packet", "source"], "left_anti")


def unavailable(references: DataFrame, sources: DataFrame) -> DataFrame:
    """References without a source: by number where they have one, else by book and page, else by a compatible type
    that holds a word (over three letters) of the description. references: packet, reference, number, book_page,
    kind, description.

    The first two are equi joins; the third joins words with the packet's distinct types, which are few."""
    r = references.withColumns({"n": letters_key(F.col("number")), "b": letters_key(F.col("book_page"))})
    s = sources.select("packet", letters_key(F.col("number")).alias("n"), letters_key(F.col("book_page")).alias("b"))
    gone = r.where("n <> ''").join(s.select("packet", "n").distinct(), ["packet", "n"], "left_anti")
    gone = gone.unionByName(r.where("n = '' and b <> ''").join(s.select("packet", "b").distinct(), ["packet", "b"], "left_anti"))
    types = sources.select("packet", F.struct(words_key(F.col("kind")).alias("k"), type_mask(cleaned(F.col("kind"))).alias("m")).alias("t")).groupBy("packet").agg(F.collect_set("t").alias("types"))
    own = F.struct(words_key(F.col("kind")).alias("k"), type_mask(cleaned(F.col("kind"))).alias("m"))
    tokens = F.filter(F.split(words_key(F.col("description")), " "), lambda t: F.length(t) > 3)
    # made before the join, so that they are not made anew for each type inside the condition
    bare = r.where("n = '' and b = ''").withColumns({"own": own, "tokens": tokens}).join(types, "packet", "left")
    named = F.exists(F.coalesce("types", F.array().cast("array<struct<k:string,m:int>>")), lambda t: compatible(F.col("own"), t) & F.exists("tokens", lambda w: F.contains(t["k"], w)))
    return gone.unionByName(bare.where(~named).drop("types", "own", "tokens")).drop("n", "b")


def overview(packets: DataFrame, matched: DataFrame, left: DataFrame, lost: DataFrame, label: str) -> DataFrame:
    """One row a packet: detected, the five counts and the summary text. packets: packet, detected; a packet whose
    summary was not detected has zeros and says so."""
    counts = matched.groupBy("packet").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(name) for s, name in ((MATCH, "matched"), (MISMATCH, "mismatched"), (MISSING, "source_missing"))])
    out = packets.select("packet", "detected").join(counts, "packet", "left")
    for rows, name in ((left, "omitted"), (lost, "unavailable")):
        out = out.join(rows.groupBy("packet").agg(F.count("*").alias(name)), "packet", "left")
    names = ["n", "matched", "mismatched", "source_missing", "omitted", "unavailable"]
    out = out.withColumns({n: F.when(F.col("detected"), F.coalesce(n, F.lit(0))).otherwise(0).cast("long") for n in names})
    part = lambda n: F.col(n).cast("string")
    said = F.concat(
        F.lit(f"{label}: "), part("n"), F.when(F.col("n") == 1, " entry; ").otherwise(" entries; "), part("matched"), F.lit(" matched, "), part("mismatched"), F.lit(" mismatched, "), part("source_missing"), F.lit(" missing source; "),
        part("omitted"), F.lit(" material source instrument(s) omitted; "), part("unavailable"), F.lit(" referenced source document(s) unavailable."),
    )
    undetected = "No distinct Run Sheet or Abstractor Sheet was supplied; Run Sheet reconciliation is not applicable." if label == "Run Sheet" else "Opening title summary was not confidently segmented; title-report-to-source reconciliation cannot be completed."
    return out.withColumn("summary", F.when(F.col("detected"), said).otherwise(undetected))


def reconcile(packets: DataFrame, entries: DataFrame, sources: DataFrame, references: DataFrame, label: str = "Title summary") -> DataFrame:
    """overview() of packets against their entries, sources and references; only detected summaries are matched."""
    seen = packets.where("detected").select("packet")
    own = lambda df: df.join(seen, "packet", "left_semi")
    matched = reconciled(own(entries), own(sources))
    return overview(packets, matched, unlisted(own(sources), matched), unavailable(own(references), own(sources)), label)
