"""The foreclosure analysis on packets made for each rule."""

import datetime

import pytest

from docketlab.operators import foreclosure, liens

LIEN = "packet string, lien string, status string, recorded date, sequence long, kind string, number string, amount string, evidence array<string>"
PACKET = "packet string, target string, target_amount string, stated string, stated_backed boolean, selection_required boolean, required boolean"


def day(n):
    return datetime.date(2020, 1, n)


@pytest.fixture(scope="module")
def rows(spark):
    stack = [
        ("a", "a1", "OPEN", day(1), 1, "Deed of Trust", "No 1", "$5", ["x", "y"]), ("a", "a2", "OPEN", day(2), 2, "Deed of Trust", "No 2", "$6", ["y", "z"]), ("a", "a3", "OPEN", day(3), 3, "HOA Lien", "", "$7", None), ("a", "a4", "RELEASED", day(4), 4, "Judgment Lien", "9", "", ["q"]),
        ("b", "b1", "OPEN", None, 1, "Deed of Trust", "1", "$5", ["x"]), ("b", "b2", "UNKNOWN", day(9), 2, "Judgment Lien", "1", "$6", ["w"]), ("b", "b3", "UNKNOWN", day(8), 2, "Judgment Lien", "1", "$8", ["v"]),
        ("c", "c1", "OPEN", day(1), None, "Deed of Trust", "1", "$5", ["x"]), ("c", "c2", "OPEN", day(1), 2, "UCC Financing Statement", "2", "$5", ["u"]),
        ("e", "e1", "RELEASED", day(1), 1, "Deed of Trust", "1", "$5", ["x"]),
    ]
    packets = [("a", "a2", "$6", None, None, False, True), ("b", "b1", "needs review", None, None, False, True), ("c", "c1", "$1", "2nd Lien", True, False, True), ("d", None, None, None, None, False, True), ("e", "e1", "$1", "1st Lien", False, False, True), ("f", None, None, None, None, True, False)]
    made = foreclosure.placed(spark.createDataFrame(packets, PACKET), foreclosure.warned(liens.lien_stack(spark.createDataFrame(stack, LIEN))))
    return made


def test_requirements(rows):
    got = {}
    for r in foreclosure.requirements(rows).collect():
        got.setdefault(r.packet, {})[r.code] = r
    assert set(got["a"]) == {"SENIOR_no1", "JUNIOR_a3", "STACK_EXCEPTION_a3"}
    assert got["a"]["SENIOR_no1"].title == "Senior open encumbrance: 1st Lien · Deed of Trust No 1 · $5." and got["a"]["SENIOR_no1"].evidence == ["x", "y"]
    assert got["a"]["JUNIOR_a3"].evidence == []
    # undated and unplaced target; of two unknown liens of one number the last in the stack (by date) speaks
    assert set(got["b"]) == {"TARGET_LIEN_AMOUNT", "TARGET_LIEN_POSITION", "PRIORITY_EXCEPTION_REVIEW", "LIEN_STATUS_1"}
    assert "$6" in got["b"]["LIEN_STATUS_1"].title and got["b"]["LIEN_STATUS_1"].evidence == ["w"]
    # a same-day peer without a sequence warns on both; the stated position stands in for the target's
    assert set(got["c"]) == {"PRIORITY_EXCEPTION_REVIEW", "STACK_EXCEPTION_2"}
    assert set(got["d"]) == set(got["e"]) == {"TARGET_LIEN_SELECTION"} and got["d"]["TARGET_LIEN_SELECTION"].evidence == []
    assert "f" not in got


def test_positions_and_evidence(rows):
    got = {r.packet: r for r in foreclosure.developed_positions(rows).collect()}
    assert (got["a"].value, got["a"].basis, got["a"].confidence, got["a"].warning, got["a"].evidence) == ("2nd Lien", "FIRST_IN_TIME", "high", "", ["x", "y", "z"])
    assert (got["b"].value, got["b"].basis, got["b"].confidence, got["b"].evidence) == ("Needs review", "UNRESOLVED", "low", ["x"])
    assert got["b"].warning.startswith("Recording date is unresolved")
    assert (got["c"].value, got["c"].basis, got["c"].evidence) == ("2nd Lien", "EXPLICIT", ["x"]) and "same recording date" in got["c"].warning
    assert (got["d"].value, got["d"].warning, got["d"].evidence) == ("Needs review", "Target lien is not resolved in the open-lien stack.", [])
    assert (got["e"].value, got["e"].basis) == ("Needs review", "UNRESOLVED")  # stated without evidence, and released


def test_stated_position_that_differs(spark):
    stack = foreclosure.warned(liens.lien_stack(spark.createDataFrame([("a", "a1", "OPEN", day(1), 1, "Deed of Trust", "1", "$5", ["x"])], LIEN)))
    row = foreclosure.developed_positions(foreclosure.placed(spark.createDataFrame([("a", "a1", "$5", "3rd Lien", True, False, True)], PACKET), stack)).first()
    assert (row.value, row.confidence) == ("3rd Lien", "high") and row.warning == "Expressly stated position (3rd Lien) differs from first-in-time screening position (1st Lien); examiner priority review required."


def test_analysis(rows):
    got = {r.packet: r for r in foreclosure.analysis(rows).collect()}
    assert (got["a"].status, got["a"].target, got["a"].open, got["a"].senior, got["a"].junior, got["a"].n) == ("REVIEW", "a2", 3, ["a1"], ["a3"], 3)
    assert (got["b"].status, got["d"].status, got["f"].status, got["f"].n) == ("CURATIVE_REQUIRED", "CURATIVE_REQUIRED", "READY", 0)


def test_targets_as_windows_equal_the_aggregate(spark, rows):
    stack = foreclosure.warned(liens.lien_stack(rows.where("lien is not null").select(*[c.split()[0] for c in LIEN.split(", ")])))
    listed = stack["lien"].isin("a1", "a2")
    want = {r.packet: r.target for r in liens.automatic_target(stack, listed).collect()}
    assert {r.packet: r.target for r in liens.targeted(stack, listed).collect()} == want and want["a"] == "a1"
