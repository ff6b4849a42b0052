"""Evidence anchors of nested extractions: collected from any depth, made to a ledger, checked against their pages, and put
back in their places as evidence ids. The shape of the nesting is read off the schema, so one plan serves any; it needs no
shuffle but for making anchors distinct and for meeting the pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from docketlab.functions import text as T
from docketlab.operators.evidence import MIN_TOKENS, RATIO, quote_tokens

#: The field that holds a node's anchors, and what an anchor has.
FIELD = "evidence"
ANCHOR = "struct<page:int,kind:string,number:string,quote:string,confidence:double>"
#: Confidence of an anchor that states none, and the type of one without.
UNSURE, UNCLASSIFIED = 0.5, "Unclassified"


def _is_anchors(name: str, kind: DataType) -> bool:
    return name == FIELD and isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {"page", "quote"} <= set(kind.elementType.names)


def _anchor(x: Column, kind: StructType) -> Column:
    have = lambda n: x[n] if n in kind.names else F.lit(None)
    return F.struct(have("page").cast("int").alias("page"), have("kind").cast("string").alias("kind"), have("number").cast("string").alias("number"), have("quote").cast("string").alias("quote"), have("confidence").cast("double").alias("confidence"))


def _gathered(col: Column, kind: DataType, path: Column) -> list[Column]:
    """Arrays of (path, anchor), one for each place of the schema that holds anchors."""
    if isinstance(kind, StructType):
        out = []
        for f in kind.fields:
            at = F.concat(path, F.lit("." + f.name))
            if _is_anchors(f.name, f.dataType):
                element = f.dataType.elementType
                out.append(_listed(col[f.name], element, at))
            else:
                out += _gathered(col[f.name], f.dataType, at)
        return out
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        if not _gathered(F.lit(None), kind.elementType, F.lit("")):
            return []

        def inner(x: Column, i: Column) -> Column:
            return _joined(_gathered(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))

        return [F.flatten(F.transform(col, inner))]
    return []


def _listed(col: Column, element: StructType, at: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        return F.struct(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), _anchor(x, element).alias("anchor"))

    return F.transform(col, one)


def _joined(parts: list[Column]) -> Column:
    none = F.array().cast(f"array<struct<path:string,anchor:{ANCHOR}>>")
    return reduce(lambda a, b: F.concat(a, F.coalesce(b, none)), parts, none)


def collected(extractions: DataFrame, raw: str = "raw") -> DataFrame:
    """packet, seq, path, anchor: all anchors of the nested column `raw`, from fields named 'evidence' at any depth of
    structs and arrays, in the order of the schema and of the arrays; path tells the place ('instruments[2].evidence[0]').
    Null structs, null arrays and packets without anchors give no rows."""
    places = _joined(_gathered(F.col(raw), extractions.schema[raw].dataType, F.lit("")))
    out = extractions.select("packet", F.posexplode(places).alias("seq", "x"))
    return out.select("packet", "seq", F.substring("x.path", F.lit(2), F.length("x.path")).alias("path"), "x.anchor")


def is_valid(a: Column) -> Column:
    """An anchor counts if it has a quote and a page from 1 on."""
    return F.coalesce((F.trim(a["quote"]) != "") & (a["page"] >= 1), F.lit(False))


def anchor_id(packet: Column, a: Column) -> Column:
    return T.evidence_id(packet, a["page"], F.coalesce(a["kind"], F.lit("")), F.coalesce(a["number"], F.lit("")), a["quote"])


def ledger(anchors: DataFrame) -> DataFrame:
    """packet, id, page, quote, kind, number, confidence, places: one row an anchor, the first of those alike in
    comparison form; confidence within 0 and 1, 0.5 where it is no number."""
    c = F.col
    rows = anchors.where(is_valid(c("anchor"))).withColumn("id", anchor_id(c("packet").cast("string"), c("anchor")))
    first = rows.groupBy("packet", "id").agg(F.min_by("anchor", "seq").alias("a"), F.count("*").alias("places"))
    sure = F.when(c("a.confidence").isNull() | F.isnan("a.confidence"), UNSURE).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("a.confidence"))))
    blank = lambda n: F.nullif(F.trim(n), F.lit(""))
    return first.select("packet", "id", "a.page", F.trim("a.quote").alias("quote"), F.coalesce(blank("a.kind"), F.lit(UNCLASSIFIED)).alias("kind"), blank("a.number").alias("number"), sure.alias("confidence"), "places")


def contained(quote: Column, page: Column, ratio: float = RATIO) -> Column:
    """Whether a page's text holds a quote, both in comparison form: whole, or `ratio` of its tokens, MIN_TOKENS or more."""
    tokens = quote_tokens(quote)
    words = F.split(page, " ")
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(words, t)))
    q = T.normalize(quote)
    return (q != "") & (page != "") & (F.contains(page, q) | ((F.size(tokens) >= MIN_TOKENS) & (hits >= ratio * F.size(tokens))))


def verified(nodes: DataFrame, pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The ledger with text_verified (its page is there, needs no visual review and holds the quote), source (the page's, if
    verified; 'native' where the page names none) and native. An anchor meets its own page alone, in one equi join.
    pages: packet, page, text, source, unseen."""
    p = pages.select("packet", "page", T.normalize(F.col("text")).alias("p"), F.col("source").alias("page_source"), "unseen")
    out = nodes.join(p, ["packet", "page"], "left")
    ok = F.coalesce(~F.coalesce("unseen", F.lit(False)) & contained(F.col("quote"), F.col("p"), ratio), F.lit(False))
    source = F.when(F.col("text_verified"), F.coalesce("page_source", F.lit("native")))
    return out.withColumn("text_verified", ok).withColumn("source", source).withColumn("native", F.coalesce(F.col("source") == "native", F.lit(False))).drop("p", "page_source", "unseen")


def _replaced(col: Column, kind: DataType, packet: Column) -> Column:
    if isinstance(kind, StructType):
        fields = []
        for f in kind.fields:
            if _is_anchors(f.name, f.dataType):
                fields.append(_ids(col[f.name], f.dataType.elementType, packet).alias("evidence_ids"))
            else:
                fields.append(_replaced(col[f.name], f.dataType, packet).alias(f.name))
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(col, lambda x: _replaced(x, kind.elementType, packet))
    return col


def _ids(col: Column, element: StructType, packet: Column) -> Column:
    known = F.filter(F.transform(col, lambda x: _anchor(x, element)), is_valid)
    return F.coalesce(F.transform(known, lambda a: anchor_id(packet, a)), F.array().cast("array<string>"))


def with_ids(extractions: DataFrame, raw: str = "raw") -> DataFrame:
    """The nested column with each list of anchors replaced by evidence_ids, the ids of those that the ledger has, in the
    same place and order. An id is a hash of packet and anchor, so nothing is looked up."""
    return extractions.withColumn(raw, _replaced(F.col(raw), extractions.schema[raw].dataType, F.col("packet").cast("string")))


def by_ids(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the ledger that are asked for. wanted: packet, id."""
    return nodes.join(wanted.select("packet", "id").distinct(), ["packet", "id"], "left_semi")


def confirmed(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """key, state of each owner of ids: CONFIRMED with a native verified one, UNCONFIRMED with any, else NOT_STATED.
    ids: packet, key, id (null where it has none)."""
    native = ids.join(nodes.select("packet", "id", "native"), ["packet", "id"], "left").groupBy("packet", "key").agg(F.max("native").alias("native"), F.count("native").alias("n"))
    return native.select("packet", "key", F.when(F.col("native"), "CONFIRMED").when(F.col("n") > 0, "UNCONFIRMED").otherwise("NOT_STATED").alias("state"))
