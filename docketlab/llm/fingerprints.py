"""Document fingerprints by I-Match with randomised lexicons, in DataFrame operations only.

Terms whose document frequency lies in a band (a range of inverse document frequency) form the lexicon. A
document's distinct lexicon terms are sorted and hashed; beside that one hash, each of several random subsets
of the lexicon, of several sizes, gives a hash of the document's terms in it. Documents that differ in few
terms agree on the subsets that hold none of those, so the share of agreeing hashes tells how alike they are.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

#: Least and most share of documents that a lexicon term is in. The lexicon has at most (mean number of
#: distinct terms) / LEAST terms, however large the corpus is.
LEAST, MOST = 1 / 2000, 1 / 5
#: Subsets: for each chain of hash bits, the terms whose first k bits are 0, for each k of DEPTHS.
CHAINS, BITS, DEPTHS = 15, 12, (3, 5, 6, 7, 8, 9, 10, 11)
#: Chains from this one on look at all terms of a text.
ALL_FROM = 10
#: Rows of a cell of neighbouring ids, most cells that are cut, and most rounds of cutting.
CELL_ROWS, MOST_CELLS, ROUNDS = 8192, 65_536, 24
GAP = "[\\x20\\x09-\\x0D]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text, lower-cased."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")
    return F.array_distinct(F.transform(split, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """term: hashes of the words whose share of the rows of docs lies in [least, most]; from all rows."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    return stored(df.where((F.col("count") >= least * n) & (F.col("count") <= max(1.0, most * n))).select("term"), "lexicon")


def _zeros(shift: int, k: int):
    return lambda t: F.shiftright(t, shift).bitwiseAND(F.lit((1 << k) - 1)) == 0


def _short(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << 24)).cast("int")


def chain_terms(hashes: list[Column]) -> list[Column]:
    """For each chain the terms in its largest subset. Five chains share the bits of one hash of a term; the last hash is
    of all terms, the others of the lexicon's."""
    return [F.filter(hashes[c // 5], _zeros(BITS * (c % 5), DEPTHS[0])) for c in range(CHAINS)]


def subset_hashes(chains: list[Column]) -> Column:
    """For each chain, one 24-bit hash of the terms in each of its random subsets, the smallest subset first; -1 where
    the document has no term in a subset."""
    none = _short(F.array().cast("array<bigint>"))
    of = lambda c, k: F.coalesce(F.nullif(_short(F.filter(chains[c], _zeros(BITS * (c % 5), k))), none), F.lit(-1))
    return F.array(*[F.array(*[of(c, k) for k in reversed(DEPTHS)]) for c in range(CHAINS)])


def likeness(a: Column, b: Column) -> Column:
    """The share of chains (0 to 1) whose smallest subset that either document has terms in has equal hashes; null
    without any such subset.

    Subsets of a chain are nested, so the smallest one is where the two are told apart most finely whatever their
    sizes: where it holds one term of the two documents together, its hashes agree just if they share that term.
    Chains are independent, so the share estimates the Jaccard likeness of the documents' lexicon terms and, for the
    rest of the chains, of all their terms; it is 1 for equal texts. Each chain is looked at once: 2 for agreement, 1 for none, 0 for no subset."""
    first = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: F.when((p == -1) & (q == -1), 0).when(p == q, 2).otherwise(1)), F.lit(0), lambda acc, v: F.when(acc == 0, v).otherwise(acc)
    )
    start = F.struct(F.lit(0).alias("agree"), F.lit(0).alias("n"))
    add = lambda acc, v: F.struct((acc["agree"] + F.when(v == 2, 1).otherwise(0)).alias("agree"), (acc["n"] + F.when(v > 0, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.zip_with(a, b, first), start, add, lambda acc: F.when(acc["n"] > 0, acc["agree"] / acc["n"]))


def as_text(hashes: Column, whole: Column) -> Column:
    six = lambda h: F.lower(F.lpad(F.hex(h), 6, "0"))
    return F.array_join(F.concat(F.transform(F.flatten(hashes), lambda h: F.when(h == -1, F.lit("------")).otherwise(six(h))), F.array(six(whole))), "")


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, o, text, cell: rows in cells that are ranges of (doc_id, o), where o is a hash of the text.

    A cell is cut again, by ids or (one id alone) by o, while it holds more than its share of rows, so that neither
    outlying ids nor many rows of one id or of none gather in one cell. How to cut the full ones (at most MOST_CELLS)
    is a table of its own."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("o"), "text", F.lit("").alias("cell"))
    share = max(CELL_ROWS, 2 * docs.count() // MOST_CELLS)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    for _ in range(ROUNDS):
        cells = rows.groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "o") for f in (F.min, F.max)])
        by_id = F.coalesce(F.col("min_doc_id") < F.col("max_doc_id"), F.lit(False))
        ends = cells.where(F.col("n") > share).select("cell", "n", by_id.alias("by_id"), *[F.when(by_id, wide(f"{f}_doc_id")).otherwise(wide(f"{f}_o")).alias(n) for f, n in (("min", "lo"), ("max", "hi"))])
        # equal rows cannot be told apart
        cuts = stored(ends.where("lo < hi").select("cell", "by_id", "lo", F.ceil((F.col("hi") - F.col("lo") + 1) / F.ceil(2 * F.col("n") / share)).cast("decimal(20,0)").alias("width")), "cuts")
        if cuts.isEmpty():
            break
        step = F.floor((F.when(F.col("by_id"), wide("doc_id")).otherwise(wide("o")) - F.col("lo")) / F.col("width")).cast("string")
        # null ids, the last of all, are a cell of their own
        moved = F.when(F.col("by_id").isNull(), F.col("cell")).otherwise(F.concat_ws("/", "cell", F.coalesce(step, F.lit("-"))))
        rows = rows.join(F.broadcast(cuts), "cell", "left").select("doc_id", "o", "text", moved.alias("cell"))
    return rows


def with_next(docs: DataFrame) -> DataFrame:
    """cell, rn, ghost, doc_id, text, next: each row's text and the next one's in descending doc_id order, after the
    last the first. A cell ends with a ghost, a copy of the next cell's first row, so each cell is finished alone and
    texts move once. Null ids come last; rows that share an id, or have none, are in order of a hash of their texts."""
    rows = placed(docs)
    order = [F.col("doc_id").desc_nulls_last(), F.col("o")]
    first = F.struct(F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(2**63 + 1)).cast("decimal(20,0)")).alias("p"), "o")
    heads = stored(rows.groupBy("cell").agg(F.min(first).alias("h")), "heads")  # one row a cell
    up = Window.orderBy("h")  # at most 2 * MOST_CELLS rows
    follow = heads.select("cell", F.coalesce(F.lead("h").over(up), F.first("h").over(up)).alias("f")).select(F.col("cell").alias("target"), F.col("f.p").alias("fp"), F.col("f.o").alias("fo"))
    here = rows.withColumn("at", first)
    both = here.join(F.broadcast(follow), (F.col("at.p") == F.col("fp")) & (F.col("at.o") == F.col("fo")), "left")
    own, copy = F.struct(F.col("cell"), F.lit(0).alias("ghost")), F.struct(F.col("target").alias("cell"), F.lit(1).alias("ghost"))
    both = both.select("doc_id", "o", "text", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at")).select("at.*", "doc_id", "o", "text")
    w = Window.partitionBy("cell").orderBy("ghost", *order, "text")
    return both.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("text").over(w))


def fingerprints(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many from the start of the next
    row's text. A null text counts as empty. Every text is hashed by its lexicon terms (two thirds of the chains) and
    by all its terms (the rest), so equal texts always agree; two texts without terms in any subset are as like as
    their whole hashes. With one row, it is its
    own next. No rows give no rows. Columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = lexicon(docs, least, most)
    words = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    rows = with_next(docs)
    n = F.char_length(F.coalesce("text", F.lit("")))
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.coalesce("text", F.lit("")), n - half), F.left(F.coalesce("next", F.lit("")), half))
    rows = rows.select("cell", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("cell", "rn", "ghost", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), terms(F.col("text")).alias("a"), F.when(F.col("ghost") == 0, terms(F.col("edited"))).otherwise(F.array().cast("array<bigint>")).alias("b"))
    head = F.struct("ghost", "doc_id", "n_chars", "sha", F.col("a").alias("all_a"), F.col("b").alias("all_b"))
    rows = rows.select("cell", "rn", "a", "b", head.alias("head"))
    kind = rows.schema["head"].dataType
    entry = lambda k: lambda t: F.struct(t.alias("term"), F.lit(k).alias("of"), F.lit(None).cast(kind).alias("head"))
    # one row without a term carries the document's own values, which are not copied to the others
    first = F.array(F.struct(F.lit(None).cast("bigint").alias("term"), F.lit(0).alias("of"), "head"))
    rows = rows.select("cell", "rn", F.explode(F.concat(first, F.transform("a", entry(1)), F.transform("b", entry(2)))).alias("t")).select("cell", "rn", "t.*")
    kept = rows.join(words.withColumn("known", F.lit(1)), "term", "left").where("of = 0 or known = 1")
    of = lambda k: F.collect_list(F.when(F.col("of") == k, F.col("term")))
    sets = kept.groupBy("cell", "rn").agg(F.get(F.collect_list("head"), F.lit(0)).alias("h"), of(1).alias("a"), of(2).alias("b"))
    base = ["cell", "rn", "ghost", "doc_id", "n_chars", "sha"]
    more = lambda c, k: F.transform(c, lambda t: F.xxhash64(t, F.lit(k)))
    sets = sets.select("cell", "rn", "h.ghost", "h.doc_id", "h.n_chars", "h.sha", *[F.sort_array(c).alias(c) for c in "ab"], *[F.sort_array(F.col(f"h.all_{c}")).alias(f"all_{c}") for c in "ab"])
    whole = {c: _short(F.concat(F.col(c), F.array(F.lit(0).cast("bigint")), F.col(f"all_{c}"))) for c in "ab"}
    sets = sets.select(*base, *[w.alias(f"w{c}") for c, w in whole.items()], *"ab", *[more(c, 2).alias(f"{c}2") for c in "ab"], *[more(f"all_{c}", 3).alias(f"{c}3") for c in "ab"])
    # each chain's terms are a column of their own, so that the subsets below do not filter all terms again
    parts = {c: chain_terms([F.col(c), F.col(f"{c}2"), F.col(f"{c}3")]) for c in "ab"}
    sets = sets.select(*base, "wa", "wb", *[p.alias(f"{c}_{i}") for c in "ab" for i, p in enumerate(parts[c])])
    made = {c: subset_hashes([F.col(f"{c}_{i}") for i in range(CHAINS)]) for c in "ab"}
    out = sets.select(*base, "wa", "wb", made["a"].alias("fa"), made["b"].alias("fb"))
    w = Window.partitionBy("cell").orderBy("rn")
    out = out.withColumn("fn", F.lead("fa").over(w)).withColumn("wn", F.lead("wa").over(w)).where("ghost = 0")
    like = lambda f, w: F.coalesce(likeness(F.col("fa"), F.col(f)), (F.col("wa") == F.col(w)).cast("double"))
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("fa"), F.col("wa")).alias("fingerprint"), as_text(F.col("fb"), F.col("wb")).alias("edited_fingerprint"), like("fb", "wb").alias("near_edited"), like("fn", "wn").alias("near_next"))
