"""What a packet's lien stack means for a foreclosure: warnings, the developed position of its target with the evidence
up to it, and the requirements. All of it is windows and one aggregation over the stack's partitioning by packet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.functions import text as T
from docketlab.operators.cascade import cleaned, letters_key

def _one_of(col: Column, names: list[str]) -> Column:
    out = F
    for n in names:
        out = out.when(col == n, D.WARNINGS[n])
    return out


def warned(stack: DataFrame) -> DataFrame:
    """liens.lien_stack() with each entry's warning: of its status, of what blocks its position, else of its kind."""
    c = F.col
    kind = _one_of(c("exception"), ["TAX", "MECHANIC", "ASSOCIATION", "UCC"]).otherwise("")
    blocked = _one_of(c("blocker"), ["UNDATED", "UNKNOWN_STATUS", "SAME_DAY"]).otherwise(kind)
    return stack.withColumn("warning", _one_of(c("status"), ["RELEASED", "UNKNOWN"]).otherwise(blocked))


def placed(packets: DataFrame, stack: DataFrame) -> DataFrame:
    """Each packet's rows of the stack (one row of nulls, where it has none) with the developed position of its target.

    packets: packet, target (a lien or null), target_amount, stated (an expressly stated position), stated_backed,
    selection_required, required (whether a target is needed at all); stack: warned(), with number, amount and evidence
    (array). Adds value, value_basis, value_confidence, value_warning, target_at (the target's position, if open and
    placed), found (the target is an open lien) and place, the row's turn in the stack: open, unknown, released; by
    position, then date."""
    c, own_packet = F.col, Window.partitionBy("packet")
    rows = packets.join(stack, "packet", "left")
    mine = F.coalesce(c("lien") == c("target"), F.lit(False))
    own = lambda x: F.max(F.when(mine, x)).over(own_packet)
    status = F.when(c("status") == "OPEN", 0).when(c("status") == "UNKNOWN", 1).otherwise(2)
    order = own_packet.orderBy(status, c("position").asc_nulls_last(), c("recorded").asc_nulls_last(), c("lien"))
    rows = rows.withColumns({"mine": mine & (c("status") == "OPEN"), "place": F.row_number().over(order), "t_label": own(c("label")), "t_status": own(c("status")), "t_at": own(c("position")), "t_confidence": own(c("confidence")), "t_warning": own(c("warning"))})
    explicit = (cleaned(c("stated")) != "") & F.coalesce("stated_backed", F.lit(False))
    in_time = (c("t_status") == "OPEN") & c("t_at").isNotNull()
    differs = F.concat(F.lit("Expressly stated position ("), "stated", F.lit(") differs from first-in-time screening position ("), "t_label", F.lit("); examiner priority review required."))
    told = F.when(explicit & (c("t_label") != T.NEEDS_REVIEW) & (F.lower("t_label") != F.lower("stated")), differs).when(explicit, F.coalesce("t_warning", F.lit(""))).when(in_time, c("t_warning"))
    by = lambda a, b, x: F.when(explicit, a).when(in_time, b).otherwise(x)
    return rows.withColumns({
        "value": by(c("stated"), c("t_label"), F.lit(T.NEEDS_REVIEW)),
        "value_basis": by(F.lit("EXPLICIT"), F.lit("FIRST_IN_TIME"), F.lit("UNRESOLVED")),
        "value_confidence": by(F.lit("high"), c("t_confidence"), F.lit("low")),
        "value_warning": F.coalesce(told, F.coalesce(F.nullif(c("t_warning"), F.lit("")), F.lit(D.WARNINGS["NO_TARGET"]))),
        "explicit": explicit, "target_at": F.when(in_time, c("t_at")), "found": F.coalesce(F.bool_or("mine").over(own_packet), F.lit(False)),
    }).drop("t_label", "t_status", "t_at", "t_confidence", "t_warning")


def developed_positions(rows: DataFrame) -> DataFrame:
    """packet, target, value, basis, confidence, warning, evidence of each packet of placed(): the distinct evidence of
    the open liens up to the target, or of the target alone where the position is stated or unresolved, in the order of
    the stack. Evidence rows are made distinct as rows; only a packet's distinct ids meet in an array."""
    c = F.col
    through = F.when(~c("explicit") & c("target_at").isNotNull(), (c("status") == "OPEN") & (c("position") <= c("target_at"))).otherwise(F.coalesce(c("lien") == c("target"), F.lit(False)))
    ids = F.when(through, c("evidence"))
    long = rows.select("packet", "target", "value", "value_basis", "value_confidence", "value_warning", "place", F.posexplode_outer(ids).alias("i", "id"))
    keys = ["packet", "target", "value", "value_basis", "value_confidence", "value_warning"]
    first = long.groupBy(*keys, "id").agg(F.min(F.struct("place", "i")).alias("at"))
    out = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(c("id").isNotNull(), F.struct("at", "id")))).alias("e"))
    return out.select("packet", "target", "value", c("value_basis").alias("basis"), c("value_confidence").alias("confidence"), c("value_warning").alias("warning"), F.transform("e", lambda x: x["id"]).alias("evidence"))


def _filled(title: str) -> Column:
    """The title with its {fields} of the row."""
    parts = re.split(r"\{(\w+)\}", title)
    return F.concat(*[F.coalesce(F.col(p), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def requirements(rows: DataFrame) -> DataFrame:
    """packet, code, type, severity, title, action, evidence (sorted ids) of placed(): each row of the stack yields the
    rules it meets; of rows with one code the last (by rule, then place) speaks, but TARGET_LIEN_SELECTION, which has the
    evidence of all open and unknown liens. A packet without liens needs a target too."""
    c = F.col
    need, is_open, no = c("required"), c("status") == "OPEN", F.lit(False)
    other = is_open & ~c("mine")
    tests = {
        "TARGET_LIEN_SELECTION": need & (c("selection_required") | ~c("found")) & ((c("place") == 1) | c("status").isin("OPEN", "UNKNOWN")),
        "TARGET_LIEN_AMOUNT": need & c("mine") & (cleaned(c("target_amount")) == ""),
        "TARGET_LIEN_POSITION": need & c("mine") & (cleaned(c("value")) == ""),
        "PRIORITY_EXCEPTION_REVIEW": need & c("mine") & (c("warning") != ""),
        "FIRST_IN_TIME_CONFIDENCE": need & (c("value_basis") == "FIRST_IN_TIME") & (c("value_confidence") != "high") & c("mine"),
        "LIEN_STATUS_": c("status") == "UNKNOWN",
        "SENIOR_": need & is_open & (c("position") < c("target_at")),
        "JUNIOR_": need & is_open & (c("position") > c("target_at")),
        "STACK_EXCEPTION_": need & other & (c("warning") != ""),
    }
    number = F.coalesce(F.nullif(letters_key(c("number")), F.lit("")), c("lien").cast("string"))
    none = F.array().cast("array<string>")
    met = [
        F.when(
            F.coalesce(tests[code], no),
            F.struct(F.lit(turn).alias("turn"), (F.concat(F.lit(code), number) if code.endswith("_") else F.lit(code)).alias("code"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), _filled(title).alias("title"), F.lit(action).alias("action")),
        )
        for turn, (code, kind, severity, title, action) in enumerate(D.REQUIREMENTS)
    ]
    backed = F.when(c("status").isin("OPEN", "UNKNOWN"), F.coalesce("evidence", none)).otherwise(none)
    long = rows.select("packet", "place", backed.alias("evidence"), F.explode(F.array_compact(F.array(*met))).alias("r")).select("packet", "place", "evidence", "r.*")
    said = F.struct("type", "severity", "title", "action", "evidence")
    out = long.groupBy("packet", "code").agg(F.max_by(said, F.struct("turn", "place")).alias("r"), F.flatten(F.collect_set("evidence")).alias("all"))
    ids = F.when(c("code") == "TARGET_LIEN_SELECTION", c("all")).otherwise(c("r.evidence"))
    return out.select("packet", "code", "r.type", "r.severity", "r.title", "r.action", F.array_sort(F.array_distinct(ids)).alias("evidence"))


def analysis(rows: DataFrame) -> DataFrame:
    """packet, status, target, value, basis, confidence, open, senior and junior (liens in order) and n requirements."""
    c = F.col
    need = requirements(rows).groupBy("packet").agg(F.bool_or(c("severity") == "BLOCKING").alias("blocking"), F.count("*").alias("n"))
    side = lambda test: F.transform(F.array_sort(F.collect_list(F.when((c("status") == "OPEN") & test, F.struct("position", "lien")))), lambda x: x["lien"])
    own = rows.groupBy("packet").agg(
        F.max(F.when(c("mine"), c("lien"))).alias("target"), F.max("value").alias("value"), F.max("value_basis").alias("basis"), F.max("value_confidence").alias("confidence"),
        F.count_if(c("status") == "OPEN").alias("open"), side(c("position") < c("target_at")).alias("senior"), side(c("position") > c("target_at")).alias("junior"),
    )
    status = F.when(c("blocking"), "CURATIVE_REQUIRED").when(c("n") > 0, "REVIEW").otherwise("READY")
    return own.join(need, "packet", "left").select("packet", status.alias("status"), "target", "value", "basis", "confidence", "open", "senior", "junior", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
