"""The evidence graph of a packet: typed nodes and edges with hashed ids, references resolved to instruments or to
synthesised external nodes, and the part of it that a question calls for. All packets' graphs are made at once, and
tables that stand together by packet (df.repartition("packet")) are not moved again: joins are on the packet alone,
and what shares a packet and a further key meets in a window (`beside`)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T

#: What a question takes of a graph: best nodes, edges at them, nodes in all.
SEEDS, EDGES, NODES = 16, 48, 28
LONG_TOKEN = 7


def unique(ids: Column) -> Column:
    """Sorted distinct ids without nulls and empty ones."""
    return F.sort_array(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def party_id(name: Column) -> Column:
    return T.digest("party_", T.upper_words(name))


def _id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value)


def _words(*parts: Column) -> Column:
    return F.concat_ws(" · ", *parts)


def _map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def beside(rows: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """rows with an array `name` of the facts (structs of their other columns) of the same packet and key; null keys
    meet nothing. A join on both columns would move both sides again, a window stays within the packet."""
    facts = facts.where(F.col("packet").isNotNull() & F.col(key).isNotNull())
    rest = [c for c in facts.columns if c not in ("packet", key)]
    fact = F.struct(*rest) if rest else F.struct(F.lit(True).alias("here"))
    both = rows.withColumn("is_row", F.lit(True)).unionByName(facts.select("packet", key, fact.alias("fact")), allowMissingColumns=True)
    met = F.collect_list("fact").over(Window.partitionBy("packet", key))
    return both.withColumn(name, met).where("is_row").drop("is_row", "fact")


def instrument_index(instruments: DataFrame) -> DataFrame:
    """packet, norm, target: the node of the last instrument (by pos) of each number in comparison form."""
    norm = T.upper_words(F.col("number"))
    return instruments.where(norm != "").groupBy("packet", norm.alias("norm")).agg(F.max_by(_id("instrument_", F.col("instrument")), F.struct("pos", "instrument")).alias("target"))


def resolved_references(instruments: DataFrame, references: DataFrame) -> DataFrame:
    """packet, instrument, reference, target, external, evidence (of the instrument): each reference that has letters
    or digits, at the instrument of its number or at a synthesised external node. references: packet, instrument,
    reference."""
    norm = T.upper_words(F.col("reference"))
    r = beside(references.where(norm != "").withColumn("norm", norm), instruments.select("packet", "instrument", "evidence"), "instrument", "of")
    r = r.select("packet", "instrument", "reference", "norm", F.explode("of.evidence").alias("evidence"))
    out = beside(r, instrument_index(instruments), "norm", "known").withColumn("target", F.get("known.target", F.lit(0))).withColumn("external", F.col("target").isNull())
    return out.withColumn("target", F.coalesce("target", T.digest("external_", F.col("norm")))).drop("norm", "known")


def _key(packets: DataFrame) -> DataFrame:
    up = lambda c: T.upper_words(F.col(c))
    return packets.select("packet", _id("packet_", F.substring("hash", 1, 24)).alias("packet_node"), T.digest("property_", F.concat_ws("|", up("state"), up("county"), up("parcel"), up("address"))).alias("property_node"))


def nodes(t: dict[str, DataFrame]) -> DataFrame:
    """packet, id, type, label, attributes, evidence: one row a node. Of rows of one id the first's label stays, the
    last's attributes, and all evidence. t: packets (packet, hash, file, review, state, county, parcel, address,
    evidence), instruments (packet, instrument, pos, kind, number, status, evidence), parties (packet, instrument, pos,
    name, role, evidence), references (packet, instrument, reference), entries (packet, entry, pos, category, kind,
    number, evidence), evidence (packet, evidence, page, kind), checks (packet, check_id, question, label, status,
    evidence)."""
    c, key = F.col, _key(t["packets"])
    packets = t["packets"].join(key, "packet")
    row = lambda df, turn, i, kind, label, attributes, evidence, pos: df.select("packet", F.struct(F.lit(turn).alias("turn"), pos.cast("long").alias("pos")).alias("at"), i.alias("id"), F.lit(kind).alias("type"), label.alias("label"), attributes.alias("attributes"), evidence.alias("evidence"))
    none = F.array().cast("array<string>")
    number = F.when(F.coalesce(c("number"), F.lit("")) != "", c("number"))
    external = resolved_references(t["instruments"], t["references"]).where("external")
    question = F.when(c("question").isNotNull(), F.concat(F.lit("Q"), c("question").cast("string")))
    raw = _all([
        row(packets, 0, c("packet_node"), "PACKET", c("file"), _map(packetHash=c("hash"), reviewId=c("review")), none, F.lit(0)),
        row(packets, 0, c("property_node"), "PROPERTY", c("address"), _map(parcelId=c("parcel"), state=c("state"), county=c("county")), c("evidence"), F.lit(0)),
        row(t["instruments"], 1, _id("instrument_", c("instrument")), "INSTRUMENT", _words(c("kind"), number), _map(instrumentId=c("instrument"), instrumentType=c("kind"), instrumentNumber=c("number"), status=c("status")), c("evidence"), c("pos")),
        row(t["parties"], 1, party_id(c("name")), "PARTY", c("name"), _map(name=c("name")), c("evidence"), c("pos")),
        row(external, 2, c("target"), "EXTERNAL_REFERENCE", c("reference"), _map(instrumentNumber=c("reference")), c("evidence"), F.xxhash64("instrument", "reference")),
        row(t["entries"], 3, T.digest("report_entry_", c("entry")), "REPORT_ENTRY", _words(F.coalesce(F.when(c("kind") != "", c("kind")), c("category")), F.coalesce(number, F.lit("unidentified"))), _map(category=c("category"), instrumentType=c("kind"), instrumentNumber=c("number")), c("evidence"), c("pos")),
        row(t["evidence"], 4, _id("evidence_", c("evidence")), "EVIDENCE", _words(F.concat(F.lit("Page "), c("page").cast("string")), c("kind")), _map(page=c("page"), documentType=c("kind")), F.array("evidence"), F.lit(0)),
        row(t["checks"], 5, T.digest("check_", c("check_id")), "CHECK", _words(question, c("label")), _map(checkId=c("check_id"), status=c("status")), c("evidence"), F.lit(0)),
    ])
    first, last = (lambda n: F.min_by(n, F.struct("at", "label"))), (lambda n: F.max_by(n, F.struct("at", "label")))
    return raw.groupBy("packet", "id").agg(first("type").alias("type"), first("label").alias("label"), last("attributes").alias("attributes"), unique(F.flatten(F.collect_list(unique(c("evidence"))))).alias("evidence"))


def edges(t: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """packet, id, src, dst, type, label, evidence: one row an edge, ids from source, target, type and label; rows of
    one edge join their evidence. targets: packet, target (an instrument or null), evidence."""
    c, key = F.col, _key(t["packets"])
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    edge = lambda a, b, kind, label, evidence: F.struct(a.alias("src"), b.alias("dst"), text(kind).alias("type"), text(label).alias("label"), evidence.alias("evidence"))
    edged = lambda df, *made: df.select("packet", F.inline(F.array(*made)))
    own = lambda name: t[name].join(key, "packet")
    instrument, packet, estate = _id("instrument_", c("instrument")), c("packet_node"), c("property_node")
    entry = T.digest("report_entry_", c("entry"))
    role = T.upper_words(c("role"))
    kind = F.when(F.contains(role, F.lit("ASSIGNOR")), "ASSIGNOR").when(F.contains(role, F.lit("ASSIGNEE")), "ASSIGNEE").otherwise("HAS_PARTY")
    parties = beside(t["parties"], t["instruments"].select("packet", "instrument", "evidence"), "instrument", "of").select("*", F.explode("of.evidence").alias("its"))
    entries = beside(own("entries").withColumn("norm", T.upper_words(c("number"))), instrument_index(t["instruments"]), "norm", "known").withColumn("target", F.get("known.target", F.lit(0)))
    known = t["evidence"].select("packet", c("evidence").alias("one")).distinct()
    backed = lambda df, node: beside(df.select("packet", node.alias("node"), F.explode(unique(c("evidence"))).alias("one")), known, "one", "found").where(F.size("found") > 0)
    check = T.digest("check_", c("check_id"))
    chosen = own("targets") if "targets" in t else targets.join(key, "packet")
    chosen = beside(chosen, t["instruments"].select("packet", c("instrument").alias("target")).distinct(), "target", "found").where(F.size("found") > 0)
    raw = _all([
        edged(own("packets"), edge(packet, estate, "CONTAINS", "packet property", c("evidence"))),
        edged(own("instruments"), edge(packet, instrument, "CONTAINS", "packet instrument", c("evidence")), edge(instrument, estate, "AFFECTS_PROPERTY", "affects property", c("evidence"))),
        edged(parties, edge(instrument, party_id(c("name")), kind, F.coalesce(F.when(c("role") != "", c("role")), F.lit("party")), F.concat(unique(c("its")), unique(c("evidence"))))),
        edged(resolved_references(t["instruments"], t["references"]), edge(instrument, c("target"), "REFERENCES", F.concat(F.lit("references "), c("reference")), c("evidence"))),
        edged(entries, edge(packet, entry, "CONTAINS", "title report entry", c("evidence")), edge(entry, F.coalesce(c("target"), estate), F.when(c("target").isNotNull(), "REPORTS_INSTRUMENT").otherwise("REPORTS_UNRESOLVED"), F.when(c("target").isNotNull(), "report/source match candidate").otherwise("report entry lacks matched supplied instrument"), c("evidence"))),
        edged(backed(t["instruments"], instrument), edge(c("node"), _id("evidence_", c("one")), "SUPPORTED_BY", "instrument evidence", F.array("one"))),
        edged(own("checks"), edge(packet, check, "CONTAINS", "review check", c("evidence"))),
        edged(backed(t["checks"], check), edge(c("node"), _id("evidence_", c("one")), "CHECK_SUPPORTED_BY", "check evidence", F.array("one"))),
        edged(chosen, edge(estate, _id("instrument_", c("target")), "TARGET_LIEN", "selected target lien", c("evidence"))),
    ])
    out = raw.groupBy("packet", "src", "dst", "type", "label").agg(unique(F.flatten(F.collect_list(unique(c("evidence"))))).alias("evidence"))
    return out.select("packet", T.digest("edge_", F.concat_ws("|", "src", "dst", "type", "label")).alias("id"), "src", "dst", "type", "label", "evidence")


def relevant(questions: DataFrame, all_nodes: DataFrame, all_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (question, packet, id, place) and edges (question, packet, id, place) that a question takes of its packet's
    graph: the SEEDS nodes that most of its tokens occur in (a token of over LONG_TOKEN letters counts twice; node id
    on ties), the first EDGES edges by id at any of them, and, edge by edge, these edges' ends until there are NODES
    nodes. questions: question, packet, tokens (array, in comparison form).

    Filling up in order is a running count: an end that is new takes the next place at its first edge, so windows by
    question say the same as a loop. Nodes and edges of a question go through these windows as rows of one table, so that
    the graph is made once, not anew for each use of its nodes."""
    words = T.normalize(F.concat_ws(" ", "type", "label", F.flatten(F.transform(F.map_entries("attributes"), lambda e: F.array(e["key"], F.coalesce(e["value"], F.lit("null")))))))
    scored = questions.join(all_nodes.select("packet", "id", words.alias("words")), "packet")
    points = F.aggregate("tokens", F.lit(0), lambda n, t: n + F.when(F.contains(F.col("words"), t), F.when(F.length(t) > LONG_TOKEN, 2).otherwise(1)).otherwise(0))
    scored = scored.select("question", "packet", "id", points.alias("score"))
    linked = questions.select("question", "packet").join(all_edges.select("packet", F.col("id").alias("edge"), "src", "dst"), "packet")
    by, is_node = Window.partitionBy("question", "packet"), F.col("edge").isNull()
    # nodes come first, edges have no score
    rows = scored.unionByName(linked, allowMissingColumns=True).withColumn("rank", F.row_number().over(by.orderBy(F.desc_nulls_last("score"), "id")).cast("long"))
    rows = rows.withColumn("place", F.when((F.col("score") > 0) & (F.col("rank") <= SEEDS), F.col("rank"))).drop("score", "rank")
    rows = rows.withColumn("seeds", F.collect_list(F.when(F.col("place").isNotNull(), F.col("id"))).over(by))
    rows = rows.where(is_node | F.array_contains("seeds", F.col("src")) | F.array_contains("seeds", F.col("dst"))).drop("seeds")
    # edges come first, nodes have none
    rows = rows.withColumn("turn", F.row_number().over(by.orderBy(F.col("edge").asc_nulls_last())).cast("long")).where(is_node | (F.col("turn") <= EDGES))
    near = rows.where(~is_node).select("question", "packet", F.col("edge").alias("id"), "src", "dst", F.col("turn").alias("place"))
    met = lambda i, place, first: F.struct(F.col(i).alias("id"), place.cast("long").alias("place"), first.cast("long").alias("first"))
    none, twice = F.lit(None), F.col("turn") * 2
    ends = rows.select("question", "packet", is_node.alias("node"), F.inline(F.when(is_node, F.array(met("id", F.col("place"), none))).otherwise(F.array(met("src", none, twice), met("dst", none, twice + 1)))))
    merged = ends.groupBy("question", "packet", "id").agg(F.min("place").alias("place"), F.min("first").alias("first"), F.bool_or("node").alias("node"))
    merged = merged.where(F.col("node") & (F.col("place").isNotNull() | (F.col("first").isNotNull() & F.col("id").isNotNull())))
    placed = merged.withColumn("place", F.row_number().over(by.orderBy(F.col("place").asc_nulls_last(), "first")).cast("long")).where(F.col("place") <= NODES)
    return placed.select("question", "packet", "id", "place"), near
