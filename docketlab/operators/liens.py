"""First-in-time ranking of recorded interests, targets and the requirements that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.functions import text as T


def lien_class(kind: Column) -> Column:
    """SECURITY, OTHER or null (releases, derivative documents, conveyance deeds and the rest)."""
    no = kind.rlike(D.RELEASE) | kind.rlike(D.DERIVATIVE) | T.is_missing(kind)
    return F.when(kind.isNull() | no, F.lit(None)).when(kind.rlike(D.SECURITY), "SECURITY").when(kind.rlike(D.CONVEYANCE), F.lit(None)).when(kind.rlike(D.OTHER_LIEN), "OTHER")


def lien_status(status: Column, released: Column, summarized: Column) -> Column:
    """Release evidence first, then the stated status, then the summary's list."""
    said = F.coalesce(status, F.lit(""))
    return F.when(released | said.rlike(D.RELEASED_STATUS), "RELEASED").when(said.rlike(D.OPEN_STATUS) | summarized, "OPEN").otherwise("UNKNOWN")


def priority_exception(kind: Column) -> Column:
    return T.first_match(kind, D.EXCEPTIONS, "")


def lien_stack(liens: DataFrame) -> DataFrame:
    """Adds position, label, basis, confidence and blocker to liens (packet, lien, status, recorded, sequence, kind).

    Only OPEN liens are ranked, by recording date, then sequence. A position stays empty when the date is
    unknown, an UNKNOWN lien is undated or not later, or a same-day peer has no sequence. One shuffle on packet.
    """
    packet = Window.partitionBy("packet")
    is_open, unknown = F.col("status") == "OPEN", F.col("status") == "UNKNOWN"
    rank = Window.partitionBy("packet", "status").orderBy(F.col("recorded").asc_nulls_last(), F.col("sequence").asc_nulls_last(), "lien")
    day = Window.partitionBy("packet", "status", "recorded")
    out = (
        liens.withColumn("turn", F.row_number().over(rank).cast("long"))
        .withColumn("peers", F.count("*").over(day))
        .withColumn("bare", F.count_if(F.col("sequence").isNull()).over(day))
        .withColumn("first_unknown", F.min(F.when(unknown, F.col("recorded"))).over(packet))
        .withColumn("undated_unknown", F.coalesce(F.bool_or(unknown & F.col("recorded").isNull()).over(packet), F.lit(False)))
    )
    blocker = (
        F.when(~is_open, F.lit(None))
        .when(F.col("recorded").isNull(), "UNDATED")
        .when(F.col("undated_unknown") | F.coalesce(F.col("first_unknown") <= F.col("recorded"), F.lit(False)), "UNKNOWN_STATUS")
        .when((F.col("peers") > 1) & (F.col("bare") > 0), "SAME_DAY")
    )
    out = out.withColumn("blocker", blocker).withColumn("position", F.when(is_open & F.col("blocker").isNull(), F.col("turn")))
    special = priority_exception(F.col("kind"))
    confidence = F.when(F.col("status") == "RELEASED", "high").when(F.col("position").isNull(), "low").when(special != "", "medium").otherwise("high")
    label = F.when(F.col("position").isNotNull(), F.concat(T.ordinal(F.col("position")), F.lit(" Lien"))).when(F.col("status") == "RELEASED", "Released").otherwise(T.NEEDS_REVIEW)
    out = out.withColumn("label", label).withColumn("confidence", confidence).withColumn("exception", special)
    return out.withColumn("basis", F.when(F.col("position").isNotNull(), "FIRST_IN_TIME").otherwise("UNRESOLVED")).drop("turn", "peers", "bare", "first_unknown", "undated_unknown")


def _target(summarized: Column, over=lambda c: c) -> Column:
    """The automatic target of a packet, from aggregates that `over` turns into windows where they are to stay by row."""
    security = lien_class(F.col("kind")) == "SECURITY"
    is_open = security & (F.col("status") == "OPEN")
    unsure, n = over(F.bool_or(security & (F.col("status") == "UNKNOWN"))), over(F.count_if(is_open))
    only, unlisted = over(F.min(F.when(is_open, F.col("lien")))), over(F.count_if(is_open & ~summarized))
    first = over(F.min(F.when(is_open & (F.col("position") == 1) & (F.col("confidence") == "high"), F.col("lien"))))
    return F.when(F.coalesce(unsure, F.lit(False)) | (n == 0), F.lit(None)).when(n == 1, only).when(unlisted == 0, first)


def automatic_target(stack: DataFrame, summarized: Column) -> DataFrame:
    """packet, target: none while a security lien's status is unknown; the only open one; or, where all open
    ones are on the summary, the one in first position of high confidence."""
    return stack.groupBy("packet").agg(_target(summarized).alias("target"))


def targeted(stack: DataFrame, summarized: Column) -> DataFrame:
    """stack with its packet's automatic target on every row: windows over the stack's own partitioning, so neither a
    join nor a shuffle is added."""
    packet = Window.partitionBy("packet")
    return stack.withColumn("target", _target(summarized, lambda c: c.over(packet)))


def _with_target(stack: DataFrame, targets: DataFrame | None) -> DataFrame:
    """stack with its packet's target (its own column, if targets is None), and the target's position if it is open
    and placed."""
    out = stack if targets is None else stack.join(targets.select("packet", "target"), "packet", "left")
    own = (F.col("lien") == F.col("target")) & (F.col("status") == "OPEN")
    return out.withColumn("target_at", F.max(F.when(own, F.col("position"))).over(Window.partitionBy("packet")))


def split_by_target(stack: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """packet, lien, side: open liens before (senior) and after (junior) the target's position."""
    placed = _with_target(stack, targets).where((F.col("status") == "OPEN") & F.col("position").isNotNull() & F.col("target_at").isNotNull())
    side = F.when(F.col("position") < F.col("target_at"), "senior").when(F.col("position") > F.col("target_at"), "junior").otherwise("target")
    return placed.select("packet", "lien", side.alias("side"))


def evidence_through(stack: DataFrame) -> DataFrame:
    """packet, lien, position, evidence: ids of the liens up to each position, in order."""
    w = Window.partitionBy("packet").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    placed = stack.where(F.col("position").isNotNull())
    return placed.select("packet", "lien", "position", F.array_join(F.collect_list(F.col("lien").cast("string")).over(w), ",").alias("evidence"))


def requirements(stack: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """packet, code, type, severity: the target rules, and one line per unknown, senior, junior and excepted lien.

    Each row of the stack yields the rules it meets, so the stack is made once and shuffled once."""
    c, number = F.col, F.col("lien").cast("string")
    is_open, mine = c("status") == "OPEN", F.coalesce(c("lien") == c("target"), F.lit(False))
    rules = [
        (c("target").isNull(), F.lit("TARGET_LIEN_SELECTION"), "EVIDENCE", "BLOCKING"),
        (mine & c("position").isNull(), F.lit("TARGET_LIEN_POSITION"), "PRIORITY_REVIEW", "BLOCKING"),
        (mine & (c("exception") != ""), F.lit("PRIORITY_EXCEPTION_REVIEW"), "PRIORITY_REVIEW", "REVIEW"),
        (mine & (c("basis") == "FIRST_IN_TIME") & (c("confidence") != "high"), F.lit("FIRST_IN_TIME_CONFIDENCE"), "PRIORITY_REVIEW", "REVIEW"),
        (c("status") == "UNKNOWN", F.concat(F.lit("LIEN_STATUS_"), number), "EVIDENCE", "REVIEW"),
        (is_open & (c("position") < c("target_at")), F.concat(F.lit("SENIOR_"), number), "PAYOFF_REVIEW", "REVIEW"),
        (is_open & (c("position") > c("target_at")), F.concat(F.lit("JUNIOR_"), number), "NOTICE_REVIEW", "REVIEW"),
        (is_open & (c("exception") != "") & ~mine, F.concat(F.lit("STACK_EXCEPTION_"), number), "PRIORITY_REVIEW", "REVIEW"),
    ]
    met = F.array_compact(F.array(*[F.when(test, F.struct(code.alias("code"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"))) for test, code, kind, severity in rules]))
    out = _with_target(stack, targets).select("packet", F.explode(met).alias("r")).select("packet", "r.*")
    return out.groupBy("packet", "code").agg(F.first("type").alias("type"), F.first("severity").alias("severity"))


def analysis(stack: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """packet, status, n: READY, REVIEW or CURATIVE_REQUIRED from the requirements."""
    need = requirements(stack, targets).groupBy("packet").agg(F.bool_or(F.col("severity") == "BLOCKING").alias("b"), F.count("*").alias("n"))
    all_packets = stack.select("packet").distinct().join(need, "packet", "left")
    status = F.when(F.col("b"), "CURATIVE_REQUIRED").when(F.col("n") > 0, "REVIEW").otherwise("READY")
    return all_packets.select("packet", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
