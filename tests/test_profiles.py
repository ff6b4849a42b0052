"""Export profiles as rows: merging, paths of nested records, gates of required fields."""

import json


from docketlab.operators import profiles as P

BASE = "client string, " + P.COLUMNS.split(", ", 1)[1]
CUSTOM = "client string, " + P.COLUMNS


def test_a_profile_keeps_required_columns_first(spark):
    base = spark.createDataFrame([("Acme", 1, "owner", "Owner", "owner", True, False, False), ("Acme", 2, "note", "Note", "note", False, False, False), ("Acme", 3, "amount", "Amount", "amount", True, True, False)], BASE)
    custom = spark.createDataFrame([(" ACME ", "p", 1, "state", "State", "state", False, False, False), (" ACME ", "p", 2, "owner", "Titleholder", "owner.name", False, False, False), ("Other", "q", 5, "state", "State", "state", False, False, False)], CUSTOM)
    got = P.merged(base, custom).orderBy("profile", "ord").collect()
    assert [(r.profile, r.ord, r.key, r.label, r.required) for r in got] == [("p", 1, "owner", "Titleholder", False), ("p", 2, "amount", "Amount", True), ("p", 3, "state", "State", False), ("q", 1, "state", "State", False)]


def test_a_change_of_rows_changes_the_export(spark):
    records = spark.createDataFrame([(1, "p", ({"name": 'Jo "X"', "n": 3}, ["a", None, "b"], None)), (2, "p", (None, None, "Needs review"))], "key long, profile string, record struct<owner:struct<name:string,n:int>,tags:array<string>,state:string>")
    rows = [("p", 2, "owner", "Owner", "owner.name", False, False, False), ("p", 1, "n", "N", "owner.n", False, False, False), ("p", 3, "tags", "Tags", "tags", False, False, False), ("p", 4, "state", "State", "state", True, False, False)]
    found = P.values(records, spark.createDataFrame(rows, P.COLUMNS))
    assert {r.key: r.line for r in P.lines(found).collect()} == {1: '"3","Jo ""X""","a | b",""', 2: '"","","","Needs review"'}
    assert {r.key: json.loads(r.json) for r in P.objects(found).collect()} == {1: {"n": "3", "owner": 'Jo "X"', "tags": "a | b", "state": None}, 2: {"n": None, "owner": None, "tags": None, "state": "Needs review"}}
    assert [(r.key, r.column, r.message) for r in P.warnings(found).orderBy("key").collect()] == [(k, "state", "required export field State is unresolved.") for k in (1, 2)]
    fewer = P.values(records, spark.createDataFrame(rows[:1], P.COLUMNS))
    assert {r.key: r.line for r in P.lines(fewer).collect()} == {1: '"Jo ""X"""', 2: '""'} and P.headers(spark.createDataFrame(rows, P.COLUMNS)).first().line == '"N","Owner","Tags","State"'


def test_texts_of_requirements_and_areas(spark):
    need = spark.createDataFrame([("p", 2, "CURE", "B.", "do b"), ("p", 1, "EVIDENCE", "A.", "do a")], "packet string, turn int, type string, title string, action string")
    issues = spark.createDataFrame([("p", 0, "C.", "do c"), ("q", 0, "D.", "do d")], "packet string, turn int, title string, action string")
    assert {r.packet: r.text for r in P.requirements_text(need, issues).collect()} == {"p": "EVIDENCE: A. ACTION: do a | CURE: B. ACTION: do b | QC/CURE: C. ACTION: do c", "q": "QC/CURE: D. ACTION: do d"}
    areas = spark.createDataFrame([("p", 1, "Tax", "NONE", "n"), ("p", 0, "Chain", "COMPLETE", "c")], "packet string, turn int, label string, status string, summary string")
    assert P.audit_text(areas).first().text == "Chain — COMPLETE: c | Tax — NONE: n"
    assert P.audit_text(areas.limit(0)).collect() == []
