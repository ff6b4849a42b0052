"""The six areas of a packet's accuracy audit, each by its own rule, and the reason of the pass/fail verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.operators.checks import CC, FAIL, NA, PASS

#: The areas' labels, in order.
LABELS = {
    "VESTING": "Vesting Deed Information",
    "CHAIN": "Chain of Title",
    "MORTGAGE": "Mortgage Information",
    "TAX": "Tax Information",
    "JUDGMENTS_LIENS": "Judgments and Liens",
    "EASEMENTS_RESTRICTIONS": "Easements and Restrictions",
}
#: References that restrict a property, and answers that begin with a no.
RESTRICTION = "(?i)easement|restriction|covenant|cc&r|declaration"
SAID_NO = "(?i)^(?:no|none|not found|not applicable|n/a)"
#: Checks named in a verdict's reason, and summaries shown where nothing is wrong.
NAMED = SHOWN = 3


def _joined(structs: Column, field: str, sep: str) -> Column:
    return F.array_join(F.transform(structs, lambda x: x[field]), sep)


def compact(checks: Column) -> Column:
    """Of an array of checks (label, status, summary): the unresolved and failed ones with their summaries, or else the
    first SHOWN summaries."""
    material = F.filter(checks, lambda x: ~x["status"].isin(PASS, NA))
    lines = F.transform(material, lambda x: F.struct(F.concat(x["label"], F.lit(": "), F.coalesce(x["summary"], F.lit(""))).alias("line")))
    shown = F.slice(F.filter(checks, lambda x: F.coalesce(x["summary"], F.lit("")) != ""), 1, SHOWN)
    rest = F.coalesce(F.nullif(_joined(shown, "summary", " | "), F.lit("")), F.lit("No applicable exception identified."))
    return F.when(F.size(material) > 0, _joined(lines, "line", " | ")).otherwise(rest)


def six_areas(packets: DataFrame, checks: DataFrame, liens: DataFrame, references: DataFrame) -> DataFrame:
    """packet, area, label, status, summary, check_ids: six rows a packet, whether or not it has checks in an area.

    VESTING and MORTGAGE are DISCREPANCIES on a failure, INCOMPLETE on an unresolved check, else ACCURATE; CHAIN alike,
    with COMPLETE; TAX asks for a confirmed tax status; JUDGMENTS_LIENS is DISCREPANCIES on a failure or a lien of unknown
    status, else PRESENT or NONE by the open liens; EASEMENTS_RESTRICTIONS, where all is resolved, PRESENT or NONE by
    restricting references or confirmed covenants.
    packets: packet, tax_state, tax_status, fiscal_year, ccrs_state, ccrs; checks: packet, check_id, turn, label, status,
    summary; liens: packet, place, status, kind, number; references: packet, kind, description. An area gathers its own
    few checks, a packet its open liens."""
    c = F.col
    areas = F.broadcast(D.areas(packets.sparkSession))
    item = F.struct("turn", "check_id", "label", "status", "summary")
    found = checks.join(areas, "check_id").groupBy("packet", "area").agg(F.array_sort(F.collect_list(item)).alias("checks"))
    lien = F.struct("place", F.concat_ws(" ", F.coalesce("kind", F.lit("")), F.coalesce("number", F.lit(""))).alias("text"))
    stack = liens.groupBy("packet").agg(F.array_sort(F.collect_list(F.when(c("status") == "OPEN", lien))).alias("open"), F.count_if(c("status") == "UNKNOWN").alias("unknown"))
    restricted = references.groupBy("packet").agg(F.bool_or(F.concat_ws(" ", "kind", "description").rlike(RESTRICTION)).alias("restricted"))
    six = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("area"), F.lit(v).alias("label")) for i, (k, v) in enumerate(LABELS.items())]))
    rows = packets.join(stack, "packet", "left").join(restricted, "packet", "left").select("*", six.alias("x")).select("*", "x.area", "x.label").drop("x")
    rows = rows.join(found, ["packet", "area"], "left")

    none = F.array().cast(found.schema["checks"].dataType)
    rows = rows.withColumns({"checks": F.coalesce("checks", none), "open": F.coalesce("open", F.array().cast(stack.schema["open"].dataType)), "unknown": F.coalesce("unknown", F.lit(0))})
    failed, unresolved = F.exists("checks", lambda x: x["status"] == FAIL), F.exists("checks", lambda x: x["status"] == CC)
    taxed = F.coalesce(c("tax_state") == "CONFIRMED", F.lit(False))
    present = F.coalesce(c("restricted"), F.lit(False)) | F.coalesce((c("ccrs_state") == "CONFIRMED") & ~F.trim("ccrs").rlike(SAID_NO), F.lit(False))
    is_ = lambda area: c("area") == area
    own = (
        F.when(is_("TAX"), F.when(taxed, "ACCURATE").otherwise("INCOMPLETE"))
        .when(is_("JUDGMENTS_LIENS"), F.when(c("unknown") > 0, "DISCREPANCIES").when(F.size("open") > 0, "PRESENT").otherwise("NONE"))
        .when(unresolved, "INCOMPLETE")
        .when(is_("EASEMENTS_RESTRICTIONS"), F.when(present, "PRESENT").otherwise("NONE"))
        .when(is_("CHAIN"), "COMPLETE")
        .otherwise("ACCURATE")
    )
    n = F.size("open").cast("string")
    of_liens = (
        F.when(c("unknown") > 0, F.concat(n, F.lit(" supported open lien(s); "), c("unknown").cast("string"), F.lit(" lien identity/identities have unresolved open/released status.")))
        .when(F.size("open") > 0, F.concat(n, F.lit(" supported open lien(s): "), _joined(c("open"), "text", "; "), F.lit(".")))
        .otherwise("No supported open lien identity remains in the developed stack.")
    )
    text = lambda v: F.coalesce(c(v), F.lit(""))
    of_tax = F.when(taxed, F.concat(F.lit("Tax status: "), text("tax_status"), F.lit("; fiscal year: "), text("fiscal_year"), F.lit("."))).otherwise("Tax status/fiscal-year evidence is incomplete or unconfirmed.")
    of_checks = compact(c("checks"))
    summary = F.when(is_("TAX"), of_tax).when(is_("JUDGMENTS_LIENS"), of_liens).when(is_("EASEMENTS_RESTRICTIONS") & present, F.concat(F.lit("Restriction/easement-related references are present. "), of_checks)).otherwise(of_checks)
    return rows.select("packet", "area", "label", F.when(failed, "DISCREPANCIES").otherwise(own).alias("status"), summary.alias("summary"), F.transform("checks", lambda x: x["check_id"]).alias("check_ids"))


def verdicts(checks: DataFrame) -> DataFrame:
    """packet, status (Pass or Fail), reason, confirmation: failures first, of which NAMED are named; else unresolved checks.
    checks: packet, turn, label, status. The named ones are the packet's first by turn, kept by a bounded sort of what
    fails."""
    c = F.col
    fails = F.array_sort(F.collect_list(F.when(c("status") == FAIL, F.struct("turn", "label"))))
    out = checks.groupBy("packet").agg(F.count_if(c("status") == FAIL).alias("failed"), F.count_if(c("status") == CC).alias("open"), F.slice(fails, 1, NAMED).alias("named"))
    some = lambda n, one, many: F.when(n == 1, one).otherwise(many)
    reason = (
        F.when(c("failed") > 0, F.concat(c("failed").cast("string"), some(c("failed"), " confirmed QC failure: ", " confirmed QC failures: "), _joined(c("named"), "label", "; "), F.lit(".")))
        .when(c("open") > 0, F.concat(c("open").cast("string"), some(c("open"), " review item remains", " review items remain"), F.lit(" unconfirmed; quality standards cannot be certified until resolved.")))
        .otherwise("All applicable review checks are resolved without an identified QC failure.")
    )
    confirmation = (
        F.when(c("failed") > 0, "The document contains the issues identified above and does not meet quality standards.")
        .when(c("open") > 0, "The document contains unresolved review items and cannot yet be certified as meeting quality standards.")
        .otherwise("The document meets all quality standards with no identified issues.")
    )
    return out.select("packet", F.when((c("failed") > 0) | (c("open") > 0), "Fail").otherwise("Pass").alias("status"), reason.alias("reason"), confirmation.alias("confirmation"))
