"""The record of a packet: what its instruments, facts, summary and references amount to, as the wide row that the checks
read. Instruments are ranked, targeted and counted over one partitioning by packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import text as T
from docketlab.operators import cascade, liens, reconcile
from docketlab.operators.cascade import cleaned, letters_key

#: Types and roles by which instruments and parties are sorted.
DEED, NO_DEED = "(?i)deed", "(?i)deed of trust|security deed"
RELEASES = "(?i)release|satisfaction|reconveyance|discharge"
CONVEYS = "(?i)deed|mortgage|deed of trust|security deed"
ASSOCIATION = "(?i)hoa|homeowners|association|condominium|assessment lien"
ASSOCIATION_ROLE = "(?i)association|creditor|claimant|lienor|beneficiary"
GRANTEE, GRANTOR = "(?i)grantee|buyer|owner", "(?i)grantor|seller"
MERS = "(?i)mers|mortgage electronic registration systems"
JUDGMENT_RELEASED = "(?i)\\brelease of judgment lien\\b|\\bjudgment lien (?:was )?(?:released|satisfied|discharged)\\b"
FACTS = ["owner", "address", "legal", "hoa", "ccrs", "federal_tax", "mers", "min", "target_number", "target_position"]


def stated(col: Column) -> Column:
    """The value without outer blanks, or 'Needs review'."""
    return F.coalesce(F.nullif(cleaned(col), F.lit("")), F.lit(T.NEEDS_REVIEW))


def overridden(value: Column, state: Column, asked: Column, auto: str) -> tuple[Column, Column]:
    """Value and state of a fact, or what a reviewer asked for instead, which is confirmed; `auto` asks for nothing."""
    given = (cleaned(asked) != "") & (F.lower(cleaned(asked)) != auto)
    return F.when(given, cleaned(asked)).otherwise(value), F.when(given, "CONFIRMED").otherwise(state)


def _pivoted(facts: DataFrame) -> DataFrame:
    """packet, and for each of FACTS its value, state and pages as <name>, <name>_state, <name>_pages."""
    best = {n: F.max(F.when(F.col("name") == n, F.struct("value", "state", "pages"))) for n in FACTS}
    out = facts.groupBy("packet").agg(*[v.alias(f"_{n}") for n, v in best.items()])
    cols = [c for n in FACTS for c in (F.col(f"_{n}.value").alias(n), F.coalesce(F.col(f"_{n}.state"), F.lit("NOT_STATED")).alias(f"{n}_state"), F.col(f"_{n}.pages").alias(f"{n}_pages"))]
    return out.select("packet", *cols)


def _released(instruments: DataFrame) -> DataFrame:
    """packet, instrument of liens that a verified release names by reference, by its own number, or in its quotes."""
    number = letters_key(F.col("number"))
    own = instruments.where(liens.lien_class(F.col("kind")).isNotNull() & (number != "")).select("packet", F.col("instrument").alias("lien"), number.alias("number"))
    events = instruments.where(F.col("kind").rlike(liens.D.RELEASE) & F.col("verified"))
    named = F.explode_outer(F.transform("refs", letters_key)).alias("refers")
    events = events.select("packet", F.col("instrument").alias("release"), number.alias("number"), letters_key(F.col("quotes")).alias("text"), named)
    return reconcile.releases(own, events).select("packet", F.col("lien").alias("instrument")).distinct().withColumn("released", F.lit(True))


def _summarized(entries: DataFrame) -> DataFrame:
    """packet, key, secured: numbers that the summary lists for lien types, and whether for a security."""
    kind = liens.lien_class(F.col("kind"))
    return entries.where(kind.isNotNull() & (letters_key(F.col("number")) != "")).groupBy("packet", letters_key(F.col("number")).alias("key")).agg(F.bool_or(kind == "SECURITY").alias("secured"))


def stacked(instruments: DataFrame, entries: DataFrame) -> DataFrame:
    """All instruments with class, lien status, position, label and confidence; status is null where an instrument is no
    lien. A lien without verified evidence is UNKNOWN."""
    c = F.col
    rows = instruments.withColumns({"class": liens.lien_class(c("kind")), "key": letters_key(c("number"))})
    rows = rows.join(_released(instruments), ["packet", "instrument"], "left").join(_summarized(entries), ["packet", "key"], "left")
    judged = c("kind").rlike("(?i)judgment") & c("quotes").rlike(JUDGMENT_RELEASED)
    status = F.when(~c("verified"), "UNKNOWN").otherwise(liens.lien_status(c("status"), F.coalesce("released", F.lit(False)) | F.coalesce(judged, F.lit(False)), c("secured").isNotNull()))
    rows = rows.withColumns({"said": c("status"), "status": F.when(c("class").isNotNull(), status), "recorded_text": c("recorded"), "recorded": F.to_date(F.regexp_extract(cascade.day_key(c("recorded")), "^\\d{4}-\\d{2}-\\d{2}$", 0).try_cast("date"))})
    return liens.lien_stack(rows.withColumns({"lien": c("instrument"), "sequence": T.sequence_key(c("number"))}))


def _roles(pattern: str) -> Column:
    """Comparison keys of the parties in a role."""
    names = F.transform(F.filter("parties", lambda p: F.coalesce(p["role"], F.lit("")).rlike(pattern)), lambda p: letters_key(p["name"]))
    return F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))


def wide(packets: DataFrame, facts: DataFrame, instruments: DataFrame, entries: DataFrame, references: DataFrame) -> DataFrame:
    """One row a packet with every column of checks.WIDE, none of them taken from a verdict made elsewhere.

    packets: packet, order_type, order_type_state, asked_type, detected, page_start, page_end, labelled (the summary is
    labelled a run sheet or abstractor sheet); facts: packet, name (of FACTS), value, state, pages; instruments: packet,
    instrument, pos, kind, number, book_page, documented, recorded, amount, status, address, legal, parties (array of
    name, role), refs, quotes, evidence, verified; entries: cascade's, with category and verified; references:
    cascade's. A packet without instruments, facts or entries has a row."""
    c, own = F.col, Window.partitionBy("packet")
    order, order_state = overridden(c("order_type"), c("order_type_state"), c("asked_type"), "auto detect")
    head = packets.withColumn("order_type", F.when(order_state == "CONFIRMED", stated(order)).otherwise(T.NEEDS_REVIEW)).join(_pivoted(facts), "packet", "left")
    head = head.withColumns({f"{n}_state": F.coalesce(f"{n}_state", F.lit("NOT_STATED")) for n in FACTS})

    # the target and all counts: windows and one aggregation over the instruments of a packet
    rows = stacked(instruments, entries).join(head.select("packet", "order_type", "target_number", "target_number_state"), "packet")
    security = c("class") == "SECURITY"
    hinted = security & (c("target_number_state") != "NOT_STATED") & (c("key") != "") & (c("key") == letters_key(c("target_number")))
    by_hint = F.min(F.when(hinted, F.struct("pos", "instrument"))).over(own)["instrument"]
    seek = F.lower(F.trim("order_type")) == "foreclosure"
    rows = liens.targeted(rows, F.coalesce("secured", F.lit(False))).withColumn("target", F.coalesce(by_hint, F.when(seek, c("target"))))
    mine, is_deed = c("instrument") == c("target"), c("kind").rlike(DEED) & ~c("kind").rlike(NO_DEED)
    sole = F.when(F.count_if(security).over(own) == 1, F.max(F.when(security, c("instrument"))).over(own))
    rows = rows.withColumn("loan", F.coalesce(F.max(F.when(security & mine, c("instrument"))).over(own), sole))
    of = lambda test, value: F.max(F.when(test, value))
    is_loan = c("instrument") == c("loan")
    named = F.filter("parties", lambda p: F.coalesce(p["role"], F.lit("")).rlike(ASSOCIATION_ROLE))
    detail = F.concat_ws(" ", F.coalesce(F.get(named, F.lit(0))["name"], F.get("parties", F.lit(0))["name"], F.lit("name not stated")), stated(c("amount")))
    legal = F.when((is_deed | security) & (cleaned(c("legal")) != ""), letters_key(c("legal")))
    counted = rows.groupBy("packet").agg(
        F.count_if(is_deed).cast("int").alias("deeds"), F.count_if(cascade.expected(c("kind"))).cast("int").alias("expected"),
        of(mine, c("instrument")).alias("target"), of(mine, stated(c("amount"))).alias("amount"), of(mine, c("verified")).alias("amount_verified"), of(mine, c("key")).alias("target_key"), of(mine, c("label")).alias("label"), of(mine, c("confidence")).alias("confidence"), of(mine, c("position")).alias("position"),
        F.coalesce(F.bool_or(security & c("status").isin("OPEN", "UNKNOWN")), F.lit(False)).alias("unsettled"),
        F.coalesce(F.bool_or(c("kind").rlike(ASSOCIATION) & ~F.contains(detail, F.lit(T.NEEDS_REVIEW))), F.lit(False)).alias("hoa_detail"),
        F.count(legal).alias("texts"), F.collect_set(legal).alias("keys"), F.count_if(security).cast("int").alias("mortgages"),
        F.coalesce(F.bool_or(security & F.exists("parties", lambda p: F.coalesce(p["name"], F.lit("")).rlike(MERS))), F.lit(False)).alias("mers_party"),
        F.count_if(c("status") == "UNKNOWN").cast("int").alias("unknown_liens"), F.count_if(c("status") == "RELEASED").cast("int").alias("released_liens"), F.count_if(c("kind").rlike(RELEASES)).cast("int").alias("releases"),
        of(is_loan, c("instrument")).alias("loan"), of(is_loan, stated(c("address"))).alias("source_address"), of(is_loan, stated(c("recorded_text"))).alias("loan_recorded"), of(is_loan, c("status")).alias("loan_status"),
    )
    # deeds of one day and pos are kept apart by instrument, so that their order does not hang on the shuffle
    dated = F.coalesce(F.nullif(cleaned(c("recorded")), F.lit("")), c("documented"))
    deeds = instruments.where(is_deed).select("packet", F.struct("pos", "instrument").alias("deed"), cascade.day_key(dated).try_cast("date").alias("dated"), _roles(GRANTEE).alias("grantees"), _roles(GRANTOR).alias("grantors"))
    chain = reconcile.chain_of_packet(reconcile.chain(deeds)).withColumnRenamed("continuous", "chain")

    # the summary against its sources
    seen = packets.where("detected").select("packet")
    listed = entries.join(seen, "packet", "left_semi")
    sources = instruments.select(*[n for n in instruments.columns if n != "parties"], F.transform("parties", lambda p: p["name"]).alias("parties")).withColumnRenamed("instrument", "source").join(seen, "packet", "left_semi")
    # one aggregation over the matches: counts, pairs of conveyances, and how many expected sources are taken
    conveys, expected = F.concat_ws(" ", "category", "kind").rlike(CONVEYS), cascade.expected(c("s_kind"))
    matched = cascade.reconciled(listed, sources, {"conveys": conveys, "expected": F.coalesce(expected, F.lit(False))})
    n_of = lambda test: F.count_if(test).cast("int")
    over = matched.groupBy("packet").agg(
        n_of(c("status") == cascade.MISMATCH).alias("mismatched"), n_of(c("status") == cascade.MISSING).alias("source_missing"), F.size(F.collect_set(F.when(c("expected"), c("source")))).alias("taken"),
        n_of(c("conveys")).alias("summary_pairs"), n_of(c("conveys") & (c("status") == cascade.MISSING)).alias("pair_missing"), n_of(c("conveys") & F.arrays_overlap("fields", F.array(F.lit("Amount"), F.lit("Parties")))).alias("amount_or_party_mismatch"),
    )
    lost = cascade.unavailable(references.join(seen, "packet", "left_semi"), sources).groupBy("packet").agg(F.count("*").cast("int").alias("unavailable"))
    priced = entries.where((letters_key(c("number")) != "") & (cleaned(c("amount")) != "")).groupBy("packet", letters_key(c("number")).alias("target_key")).agg(F.min_by(F.struct(cleaned(c("amount")).alias("amount"), "verified"), F.struct("ord", "entry")).alias("entry"))

    out = head.join(counted, "packet", "left").join(chain, "packet", "left").join(over, "packet", "left").join(lost, "packet", "left").join(priced, ["packet", "target_key"], "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("int").alias(n)
    no = lambda n: F.coalesce(n, F.lit(False)).alias(n)
    from_source = c("amount") != T.NEEDS_REVIEW
    amount_state = F.when(from_source, F.when(c("amount_verified"), "CONFIRMED").otherwise("UNCONFIRMED")).when(c("entry").isNotNull(), F.when(c("entry.verified"), "CONFIRMED").otherwise("UNCONFIRMED")).otherwise("NOT_STATED")
    placed = F.when(c("position").isNull(), "NOT_STATED").when(c("confidence") == "high", "CONFIRMED").otherwise("UNCONFIRMED")
    omitted = F.when(c("detected"), F.coalesce("expected", F.lit(0)) - F.coalesce("taken", F.lit(0))).otherwise(0).cast("int")
    missing = (F.coalesce("source_missing", F.lit(0)) + F.coalesce("unavailable", F.lit(0))).cast("int")
    fact_legal = cleaned(c("legal")) != ""
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    return out.select(
        "packet", "order_type", "owner_state", zero("deeds"), "chain", "target",
        (seek & c("target").isNull() & F.coalesce("unsettled", F.lit(False))).alias("selection_required"),
        F.when(from_source, c("amount")).otherwise(F.coalesce("entry.amount", F.lit(T.NEEDS_REVIEW))).alias("target_amount"), amount_state.alias("target_amount_state"),
        F.when(c("target_position_state") == "CONFIRMED", "CONFIRMED").otherwise(placed).alias("target_position_state"),
        *[x for n in ("hoa", "ccrs") for x in (stated(c(n)).alias(n), f"{n}_state")], no("hoa_detail"), zero("summary_pairs"), c("detected").alias("summary_detected"),
        zero("mismatched").alias("summary_mismatched"), omitted.alias("summary_omitted"), missing.alias("summary_missing"), zero("pair_missing"), zero("amount_or_party_mismatch"),
        (F.coalesce("texts", F.lit(0)) + fact_legal.cast("int")).cast("int").alias("legal_texts"),
        F.size(F.when(fact_legal, F.array_union(keys, F.array(letters_key(c("legal"))))).otherwise(keys)).alias("legal_keys"), zero("mortgages"), stated(c("mers")).alias("mers"), "mers_state", no("mers_party"),
        stated(c("federal_tax")).alias("federal_tax"), "federal_tax_state", zero("unknown_liens"), zero("released_liens"), zero("releases"), stated(c("address")).alias("report_address"), F.coalesce("source_address", F.lit(T.NEEDS_REVIEW)).alias("source_address"), "loan",
        F.coalesce("loan_recorded", F.lit(T.NEEDS_REVIEW)).alias("loan_recorded"), "loan_status", F.when(cleaned(c("min")) == "", "NOT_STATED").otherwise(c("min_state")).alias("min_state"), F.coalesce("min_pages", F.array().cast("array<int>")).alias("min_pages"),
        F.when(c("detected"), c("page_start")).alias("page_start"), F.when(c("detected"), c("page_end")).alias("page_end"), (c("detected") & c("labelled")).alias("sheet_detected"), zero("mismatched").alias("sheet_mismatched"), omitted.alias("sheet_omitted"), missing.alias("sheet_missing"),
    )
