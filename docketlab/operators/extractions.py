"""Merging what several extractions of one packet say: instruments by tiered keys, summary entries, references and the
summary's bounds. Rows of a small group are gathered and folded in place; of a larger one, values, parties, references
and anchors become rows first, so that a group of any size is aggregated piecewise and only what is distinct in it is
gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T

FIELDS = ["kind", "number", "book_page", "documented", "recorded", "amount", "status", "address", "legal"]
#: evidence of an extraction
ANCHOR = "struct<page:int,kind:string,number:string,quote:string,confidence:double>"
#: Rows up to which a group is gathered whole; a larger one goes piece by piece, with the same result.
GATHERED = 1_000


def _norm(name: str) -> Column:
    return T.upper_words(F.col(name))


def first_page(evidence: Column) -> Column:
    """The smallest page above 0 of the anchors, or 0."""
    return F.coalesce(F.array_min(F.filter(F.transform(evidence, lambda e: e["page"]), lambda p: p > 0)), F.lit(0))


def instrument_key(evidence: str = "evidence") -> Column:
    """By number where it is stated; else by type, book and page; else by type, first page and date."""
    page = first_page(F.col(evidence)).cast("string")
    return (
        F.when(~T.is_missing(F.col("number")), F.concat(F.lit("NUM:"), _norm("number")))
        .when(~T.is_missing(F.col("book_page")), F.concat(F.lit("BOOK:"), _norm("kind"), F.lit(":"), _norm("book_page")))
        .otherwise(F.concat(F.lit("PAGE:"), _norm("kind"), F.lit(":"), page, F.lit(":"), _norm("documented")))
    )


def anchor_form(a: Column) -> Column:
    return F.concat_ws("|", a["page"].cast("string"), T.upper_words(a["kind"]), T.upper_words(a["number"]), T.upper_words(a["quote"]))


def _pieces(items: Column, name: str, norm, body) -> Column:
    """One struct (f, i, norm, and the item's parts) an item of an array column."""
    empty = F.coalesce(items, F.array())
    return F.transform(empty, lambda x, i: F.struct(F.lit(name).alias("f"), i.alias("i"), norm(x).alias("norm"), body(x).alias("body")))


def _body(value: Column | None = None, role: Column | None = None, anchor: Column | None = None) -> Column:
    text, none = (lambda c: (c if c is not None else F.lit(None)).cast("string")), F.lit(None).cast(ANCHOR)
    return F.struct(text(value).alias("value"), text(role).alias("role"), (anchor if anchor is not None else none).cast(ANCHOR).alias("anchor"))


def merge_instruments(rows: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """One row a packet and key: each field's most frequent value in comparison form, by its first spelling (the longer,
    then the earlier one on a tie; 'Not Stated' where none is stated); parties by role and name, references and anchors,
    each once by its first occurrence, anchors by page and falling confidence; n, how many rows met. Rows of one pos
    follow by what they say.

    A group of which every field is missing is still a row. Rows move once, as they are, by packet and key. A group of up
    to `gathered` rows is folded where it has arrived, as one item that holds its rows. Rows of a larger one are taken
    apart there: what says the same is counted in fixed-width buffers, so that no exploded row is sorted, and only what is
    distinct meets the votes. Both ways say the same.
    rows: packet, pos, FIELDS, parties (array of name, role), refs (array), evidence (array of ANCHOR)."""
    keyed = rows.select("packet", instrument_key().alias("key"), F.struct("pos", *FIELDS, "parties", "refs", "evidence").alias("x")).repartition("packet", "key")
    sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("packet", "key")))
    spread = F.when(F.col("n") > gathered, F.monotonically_increasing_id())
    piled = sized.groupBy("packet", "key", "n", spread.alias("spread")).agg(F.collect_list("x").alias("rows")).withColumn("x", F.get("rows", F.lit(0)))
    values = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("norm"), _body(F.col("x")[f]).alias("body")) for f in FIELDS])
    row = F.array(F.struct(F.lit("row").alias("f"), F.lit(0).alias("i"), F.lit("").alias("norm"), _body().alias("body")))
    parties = _pieces(F.col("x.parties"), "party", _party_form, lambda p: _body(p["name"], p["role"]))
    refs = F.filter(_pieces(F.col("x.refs"), "ref", lambda r: F.coalesce(r, F.lit("")), lambda r: _body(r)), lambda x: ~T.is_missing(x["norm"]))
    anchors = _pieces(F.col("x.evidence"), "anchor", anchor_form, lambda a: _body(anchor=a))
    whole = F.array(F.struct(F.lit("rows").alias("f"), F.lit(0).alias("i"), F.lit("").alias("norm"), _body().alias("body")))
    items = F.when(F.col("spread").isNull(), whole).otherwise(F.concat(row, values, parties, refs, anchors))
    long = piled.select("packet", "key", F.col("x.pos").alias("pos"), F.when(F.col("spread").isNull(), F.col("rows")).alias("rows"), F.explode(items).alias("item")).select("packet", "key", "pos", "rows", "item.*")
    said = long.groupBy("packet", "key", "f", "norm", "i", "body", "rows").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    # a field's form is made once a distinct value; a filter on it would be pushed down to every row, so missing ones only lose their vote
    said = said.withColumn("norm", F.when(F.col("f").isin(*FIELDS), T.upper_words(F.col("body.value"))).otherwise(F.col("norm")))
    seen = said.groupBy("packet", "key", "f", "norm").agg(F.sum("n").alias("n"), F.min(F.struct("pos", "i")).alias("at"), F.min_by("body", F.struct("pos", "i", "body")).alias("body"), F.max("rows").alias("rows"))
    vote = F.struct("n", F.length("body.value").alias("len"), (-F.col("at.pos")).alias("early"), F.col("body.value").alias("value"))
    of = lambda f, c: F.when(F.col("f") == f, c)
    stated = (F.col("norm") != "") & ~F.col("norm").isin(*T.MISSING)
    listed = lambda f: F.array_sort(F.collect_list(of(f, F.struct("at", "body"))))
    best = [F.coalesce(F.max(F.when((F.col("f") == f) & stated, vote))["value"], F.lit(T.NOT_STATED)).alias(f) for f in FIELDS]
    ranked = F.array_sort(F.collect_list(of("anchor", F.struct(F.col("body.anchor.page").alias("page"), (-F.col("body.anchor.confidence")).alias("low"), "at", F.col("body.anchor").alias("a")))))
    out = seen.groupBy("packet", "key").agg(*best, F.max(of("row", F.col("n"))).alias("n"), listed("party").alias("p"), listed("ref").alias("r"), ranked.alias("e"), F.max("rows").alias("rows"))
    party = F.transform("p", lambda x: F.struct(x["body"]["value"].alias("name"), x["body"]["role"].alias("role")))
    counted = out.select("packet", "key", *FIELDS, "n", party.alias("parties"), F.transform("r", lambda x: x["body"]["value"]).alias("refs"), F.transform("e", lambda x: x["a"]).alias("evidence"), "rows")
    return _folded(counted)


def _party_form(p: Column) -> Column:
    return F.concat_ws("|", T.upper_words(p["role"]), T.upper_words(p["name"]))


def _folded(merged: DataFrame) -> DataFrame:
    """merge_instruments of groups that hold their rows, in the place of their other columns: what says the same stands
    together once sorted by form. Groups without rows stay as they are."""
    size = F.size("rows")
    known = lambda norm: (norm != "") & ~norm.isin(*T.MISSING)

    def said(field: str) -> Column:
        stated = F.transform(F.filter("rows", lambda x: x[field].isNotNull()), lambda x: F.struct(T.upper_words(x[field]).alias("norm"), x["pos"].alias("pos"), x[field].alias("value")))
        return F.when(size > 1, F.sort_array(F.filter(stated, lambda x: known(x["norm"]))))

    def voted(field: str) -> Column:
        values = f"_{field}"
        vote = lambda n, x: F.struct(n.alias("n"), F.length(x["value"]).alias("len"), (-x["pos"]).alias("early"), x["value"].alias("value"))
        first = F.get(values, F.lit(0))
        start = F.struct(F.lit(0).alias("n"), first.alias("x"), vote(F.lit(0), first).alias("best"))

        def step(held: Column, x: Column) -> Column:
            # a run of one form keeps its first spelling; the best run so far is held beside it
            same = held["x"]["norm"] == x["norm"]
            n, at = F.when(same, held["n"] + 1).otherwise(1), F.when(same, held["x"]).otherwise(x)
            return F.struct(n.alias("n"), at.alias("x"), F.greatest(held["best"], vote(n, at)).alias("best"))

        most = F.aggregate(values, start, step, lambda held: held["best"]["value"])
        only = F.col("row")[field]
        return F.when(F.col("row").isNotNull(), F.when(T.is_missing(only), T.NOT_STATED).otherwise(only)).when(F.size(values) == 0, T.NOT_STATED).when(F.size(values) == 1, first["value"]).otherwise(most)

    def firsts(items: str, norm, body) -> Column:
        """at (pos, i) and body of the first item of each form."""
        empty = lambda x: F.coalesce(x[items], F.array())
        every = F.flatten(F.transform("rows", lambda x: F.transform(empty(x), lambda y, i: F.struct(norm(y).alias("norm"), F.struct(x["pos"].alias("pos"), i.alias("i")).alias("at"), body(y).alias("body")))))
        return F.sort_array(every)

    alone = lambda name: F.filter(name, lambda x, i: (i == 0) | (F.get(name, i - 1)["norm"] != x["norm"]))
    refs = F.filter(firsts("refs", lambda r: F.coalesce(r, F.lit("")), lambda r: r), lambda x: ~T.is_missing(x["norm"]))
    part = {f"_{f}": said(f) for f in FIELDS} | {"p": firsts("parties", _party_form, lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"))), "r": refs, "e": firsts("evidence", anchor_form, lambda a: a.cast(ANCHOR))}
    out = merged.withColumns(part | {"row": F.when(size == 1, F.get("rows", F.lit(0)))})
    ordered = lambda name: F.transform(F.sort_array(F.transform(alone(name), lambda x: F.struct(x["at"].alias("at"), x["body"].alias("body")))), lambda x: x["body"])
    ranked = F.sort_array(F.transform(alone("e"), lambda x: F.struct(x["body"]["page"].alias("page"), (-x["body"]["confidence"]).alias("low"), x["at"].alias("at"), x["body"].alias("a"))))
    made = {f: voted(f) for f in FIELDS} | {"n": size.cast("long"), "parties": ordered("p"), "refs": ordered("r"), "evidence": F.transform(ranked, lambda x: x["a"])}
    return out.select("packet", "key", *[F.when(F.col("rows").isNotNull(), c).otherwise(F.col(n)).alias(n) for n, c in made.items()])


ENTRY_FIELDS = ["category", "kind", "number", "book_page", "documented", "recorded", "amount", "parties", "legal"]


def entry_key() -> Column:
    page = F.coalesce(F.get(F.col("evidence"), F.lit(0))["page"], F.lit(0)).cast("string")
    return F.when(~T.is_missing(F.col("number")), F.concat(F.lit("NUM:"), _norm("number"), F.lit(":"), _norm("category"))).otherwise(F.concat_ws("|", _norm("category"), _norm("kind"), _norm("book_page"), page))


def with_unique_anchors(group: DataFrame, anchors: Column) -> DataFrame:
    """The rows with evidence: anchors of one comparison form once, the first of them; by page and falling confidence.

    Forms are made once and sorted, so that an anchor is compared with the one before it alone."""
    at = lambda i: F.get("_formed", i)
    formed = group.withColumn("_formed", F.array_sort(F.transform(anchors, lambda a, i: F.struct(anchor_form(a).alias("form"), i.alias("i"), a.alias("a")))))
    firsts = F.filter("_formed", lambda x, i: (i == 0) | (at(i - 1)["form"] != x["form"]))
    ranked = F.array_sort(F.transform(firsts, lambda x: F.struct(x["a"]["page"].alias("page"), (-x["a"]["confidence"]).alias("low"), x["i"].alias("i"), x["a"].alias("a"))))
    return formed.withColumn("evidence", F.transform(ranked, lambda x: x["a"])).drop("_formed")


def merge_entries(rows: DataFrame) -> DataFrame:
    """One row a packet and entry key, its rows joined one after the other: a field keeps its value unless the next one
    is stated, differs in comparison form and is longer, or none was stated so far. What is kept hangs on the order, so
    each key's rows are folded in order. A key's only row keeps its values as they are, missing ones too.
    rows: packet, pos, ENTRY_FIELDS, evidence."""
    item = F.struct("pos", *ENTRY_FIELDS, "evidence")
    group = rows.groupBy("packet", entry_key().alias("key")).agg(F.array_sort(F.collect_list(item)).alias("rows"), F.count("*").alias("n"))

    def folded(field: str) -> Column:
        first = F.get("rows", F.lit(0))[field]
        start = F.when(~T.is_missing(first), first)

        def step(held: Column, x: Column) -> Column:
            new = x[field]
            take = ~T.is_missing(new) & (held.isNull() | ((T.upper_words(new) != T.upper_words(held)) & (F.length(new) > F.length(held))))
            return F.when(take, new).otherwise(held)

        return F.when(F.col("n") == 1, first).otherwise(F.coalesce(F.aggregate("rows", start, step), F.lit(T.NOT_STATED)))

    anchors = F.flatten(F.transform("rows", lambda x: F.coalesce(x["evidence"], F.array().cast(f"array<{ANCHOR}>"))))
    return with_unique_anchors(group, anchors).select("packet", "key", "n", F.get("rows", F.lit(0))["pos"].alias("pos"), *[folded(f).alias(f) for f in ENTRY_FIELDS], "evidence")


def merge_references(rows: DataFrame) -> DataFrame:
    """The first row of each type, number, book and page and description in comparison form, with all anchors once.
    rows: packet, pos, kind, number, book_page, description, evidence."""
    form = F.concat_ws("|", _norm("kind"), _norm("number"), _norm("book_page"), _norm("description"))
    group = rows.groupBy("packet", form.alias("key")).agg(F.min(F.struct("pos", "kind", "number", "book_page", "description")).alias("first"), F.array_sort(F.collect_list(F.struct("pos", "evidence"))).alias("all"))
    anchors = F.flatten(F.transform("all", lambda x: F.coalesce(x["evidence"], F.array().cast(f"array<{ANCHOR}>"))))
    return with_unique_anchors(group, anchors).select("packet", "key", "first.*", "evidence")


def summary_bounds(parts: DataFrame) -> DataFrame:
    """packet, detected, page_start, page_end over a packet's extractions: the least start and greatest end above 0 of
    those that detected a summary, 0 where none did. parts: packet, detected, page_start, page_end."""
    of = lambda c: F.when(F.col("detected") & (F.col(c) > 0), F.col(c))
    return parts.groupBy("packet").agg(F.coalesce(F.bool_or("detected"), F.lit(False)).alias("detected"), F.coalesce(F.min(of("page_start")), F.lit(0)).alias("page_start"), F.coalesce(F.max(of("page_end")), F.lit(0)).alias("page_end"))
