"""The 26 checks, the evidence gate, reductions, overlays and audit areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.functions import text as T

PASS, FAIL, CC, NA = "PASS", "FAIL", "CANNOT_CONFIRM", "NOT_APPLICABLE"


def negative(value: Column) -> Column:
    """A stated no. A word boundary follows, so names that begin with these letters are none."""
    return F.lower(F.coalesce(value, F.lit(""))).rlike("^\\s*(?:no|none|not applicable|n/a|not found)\\b")


def _answer(cond: Column, yes: str = PASS, no: str = CC) -> Column:
    return F.when(cond, yes).otherwise(no)


def _reconciled(prefix: str) -> Column:
    """Over counts: nothing detected or sources missing cannot be confirmed, mismatches or omissions fail."""
    c = lambda n: F.col(f"{prefix}_{n}")
    return F.when(~c("detected"), CC).when((c("mismatched") > 0) | (c("omitted") > 0), FAIL).when(c("missing") > 0, CC).otherwise(PASS)


def check_columns() -> dict[str, Column]:
    """Each check as one expression over a packet's wide row (see WIDE)."""
    c = F.col
    second, current = [F.coalesce(F.lower(F.trim("order_type")), F.lit("")) == k for k in ("2nd lien", "current owner search")]
    # an answer such as n/a is one; only the placeholder is not
    stated = lambda n: F.coalesce(c(n) != T.NEEDS_REVIEW, F.lit(False))
    answered = lambda n: (c(f"{n}_state") == "CONFIRMED") & stated(n)
    return {
        "CURRENT_OWNER_ESTABLISHED": _answer(c("owner_state") == "CONFIRMED"),
        "PRIOR_OWNER_ESTABLISHED": F.when(current, CC).otherwise(_answer(c("deeds") >= 2)),
        "OWNERSHIP_CHAIN_COMPLETE": F.when(current | c("chain").isNull(), CC).when(c("chain"), PASS).otherwise(FAIL),
        "TARGET_LIEN_FOUND": _answer(c("target").isNotNull() & ~c("selection_required")),
        "TARGET_LIEN_AMOUNT": _answer(c("target").isNotNull() & answered("target_amount")),
        "TARGET_LIEN_POSITION_ESTABLISHED": _answer(c("target_position_state").isin("CONFIRMED", "EXAMINER_CONFIRMED")),
        "HOA_STATUS_REVIEWED": F.when(second, NA).otherwise(_answer(answered("hoa"))),
        "CCRS_REVIEWED": F.when(second, NA).otherwise(_answer(answered("ccrs"))),
        "HOA_NAME_AMOUNTS_REVIEWED": F.when(second | (answered("hoa") & negative(c("hoa"))), NA).otherwise(_answer(c("hoa_detail"))),
        "DEED_MORTGAGE_ACCURACY": F.when(~c("summary_detected") | (c("summary_pairs") == 0) | (c("pair_missing") > 0), CC).when(c("amount_or_party_mismatch") > 0, FAIL).otherwise(PASS),
        "RECORDED_DOCUMENTS_RECONCILE": _reconciled("summary"),
        "RECORDING_ORDER_RECONCILES": F.lit(CC),
        "ASSIGNMENT_CHAIN_COMPLETE": F.lit(CC),
        "LEGAL_DESCRIPTION_RECONCILES": _answer((c("legal_texts") >= 2) & (c("legal_keys") == 1)),
        "MERS_BENEFICIARY_REVIEWED": F.when(c("mortgages") == 0, NA).otherwise(_answer(answered("mers") | c("mers_party"))),
        "FEDERAL_TAX_LIEN_REVIEWED": _answer(answered("federal_tax") & negative(c("federal_tax")), NA),
        "RELEASES_RECONCILED": F.when(c("unknown_liens") > 0, CC).when((c("released_liens") > 0) | (c("releases") > 0), PASS).otherwise(NA),
        "PROPERTY_IDENTITY_RECONCILES": F.when(c("loan").isNull() | ~stated("report_address") | ~stated("source_address"), CC).otherwise(_answer(T.address_key(c("report_address")) == T.address_key(c("source_address")), PASS, FAIL)),
        "LOAN_DOCUMENT_TYPE_REVIEWED": _answer(c("loan").isNotNull()),
        "LOAN_RECORDING_DATE_REVIEWED": _answer(c("loan").isNotNull() & stated("loan_recorded")),
        "LOAN_STATUS_REVIEWED": _answer(c("loan").isNotNull() & (F.coalesce(c("loan_status"), F.lit("UNKNOWN")) != "UNKNOWN")),
        "RECOURSE_REVIEWED": F.lit(NA),
        "MATERIAL_REPORT_ERRORS_REVIEWED": F.when((c("summary_mismatched") > 0) | (c("summary_omitted") > 0), FAIL).when((c("summary_missing") > 0) | ~c("summary_detected"), CC).otherwise(PASS),
        "PLAT_REQUIREMENT_REVIEWED": F.lit(CC),
        "MIN_RUN_SHEET_REVIEWED": F.when((c("mortgages") == 0) | (answered("mers") & negative(c("mers"))), NA).when(c("min_state") != "CONFIRMED", CC).otherwise(_answer(F.exists("min_pages", lambda p: p.between(c("page_start"), c("page_end"))))),
        "RUN_SHEET_RECONCILES": F.when(c("sheet_detected"), _reconciled("sheet")).otherwise(_reconciled("summary")),
    }


#: The wide row of a packet that the checks read.
WIDE = (
    "packet string, order_type string, owner_state string, deeds int, chain boolean, target string, selection_required boolean, target_amount string, target_amount_state string,"
    " target_position_state string, hoa string, hoa_state string, ccrs string, ccrs_state string, hoa_detail boolean, summary_pairs int, summary_detected boolean,"
    " summary_mismatched int, summary_omitted int, summary_missing int, pair_missing int, amount_or_party_mismatch int, legal_texts int, legal_keys int, mortgages int, mers string,"
    " mers_state string, mers_party boolean, federal_tax string, federal_tax_state string, unknown_liens int, released_liens int, releases int, report_address string, source_address string, loan string,"
    " loan_recorded string, loan_status string, min_state string, min_pages array<int>, page_start int, page_end int, sheet_detected boolean, sheet_mismatched int,"
    " sheet_omitted int, sheet_missing int"
)


def evaluate(wide: DataFrame) -> DataFrame:
    """packet, check_id, status for the checks of each packet's profile: one pass over the wide rows, then one
    unpivot; profiles are a small broadcast table."""
    cols = check_columns()
    long = wide.select("packet", "order_type", F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("status")) for k, v in cols.items()])).alias("x")).select("packet", "order_type", "x.*")
    known = F.lower(F.trim(F.coalesce("order_type", F.lit(""))))
    profile = F.coalesce(*[F.when(known == name.lower(), name) for name in D.PROFILES], F.lit("Needs review"))
    table = F.broadcast(D.profile_checks(wide.sparkSession))
    return long.withColumn("order_type", profile).join(table, ["order_type", "check_id"]).select("packet", "check_id", "status")


def reduced(checks: DataFrame, by: list[str]) -> DataFrame:
    """qc_status and counts: any unresolved check means REVIEW, else any failure FAIL, else PASS."""
    agg = checks.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("status") == FAIL).alias("failed"), F.count_if(F.col("status") == CC).alias("unresolved"))
    status = F.when(F.col("unresolved") > 0, "REVIEW").when(F.col("failed") > 0, "FAIL").otherwise("PASS")
    final = F.when((F.col("failed") > 0) | (F.col("unresolved") > 0), "Fail").otherwise("Pass")
    return agg.withColumn("qc_status", status).withColumn("pass_fail", final)


def issues(checks: DataFrame) -> DataFrame:
    """packet, check_id, code, severity of the failed and unresolved checks; unresolved QC issues are REVIEW."""
    meta = F.broadcast(D.checks(checks.sparkSession).select("check_id", "code", "severity"))
    unresolved = F.col("status") == CC
    out = checks.where(F.col("status").isin(FAIL, CC)).join(meta, "check_id")
    return out.select("packet", "check_id", F.when(unresolved, F.concat(F.lit("CANNOT_CONFIRM_"), "code")).otherwise(F.col("code")).alias("code"), F.when(unresolved & (F.col("severity") == "QC"), "REVIEW").otherwise(F.col("severity")).alias("severity"), unresolved.alias("unresolved"))


def readiness(found: DataFrame, by: str) -> DataFrame:
    sure = F.bool_or((F.col("severity") == "BLOCKING") & ~F.col("unresolved"))
    agg = found.groupBy(by).agg(sure.alias("b"), F.bool_or(F.col("unresolved") | (F.col("severity") == "REVIEW")).alias("r"))
    return agg.select(by, F.when(F.col("b"), "CURATIVE_REQUIRED").when(F.col("r"), "REVIEW").otherwise("QC").alias("readiness"))


def audit_areas(checks: DataFrame, areas: DataFrame, by: list[str]) -> DataFrame:
    """by, area, status: any failure DISCREPANCIES, any unresolved check INCOMPLETE, else ACCURATE (CHAIN:
    COMPLETE). One check may count in several areas."""
    agg = checks.join(F.broadcast(areas), "check_id").groupBy(*by, "area").agg(F.bool_or(F.col("status") == FAIL).alias("f"), F.bool_or(F.col("status") == CC).alias("u"))
    return agg.select(*by, "area", F.when(F.col("f"), "DISCREPANCIES").when(F.col("u"), "INCOMPLETE").when(F.col("area") == "CHAIN", "COMPLETE").otherwise("ACCURATE").alias("status"))


def integrity_guard(checks: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Downgrades PASS where every cited page is unreadable. checks: packet, check_id, status, page; unreadable: packet, page."""
    bad = unreadable.select("packet", "page").distinct().withColumn("bad", F.lit(True))
    seen = checks.join(bad, ["packet", "page"], "left").groupBy("packet", "check_id", "status").agg(F.bool_and(F.coalesce("bad", F.lit(False))).alias("lost"))
    return seen.select("packet", "check_id", F.when((F.col("status") == PASS) & F.col("lost"), CC).otherwise(F.col("status")).alias("status"), "lost")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: append-only logs, last writer wins."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def overlaid(checks: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Checks with the latest decision's status over their own. decisions: keys, decided."""
    out = checks.join(decisions.select(*keys, "decided"), keys, "left")
    return out.withColumn("final", F.coalesce("decided", "status")).withColumn("overridden", F.coalesce(F.col("decided") != F.col("status"), F.lit(False)))


def resolved(checks: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Semantic resolutions count only for unresolved checks, and conclusive ones only with evidence."""
    r = resolutions.select("packet", "check_id", F.col("status").alias("said"), F.size("evidence").alias("n"))
    fine = (F.col("status") == CC) & F.col("said").isNotNull() & ((F.col("n") > 0) | ~F.col("said").isin(PASS, FAIL))
    return checks.join(r, ["packet", "check_id"], "left").withColumn("status", F.when(fine, F.col("said")).otherwise(F.col("status"))).drop("said", "n")
