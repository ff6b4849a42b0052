"""Operators on fixtures of the review domain."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketlab.functions import dimensions as D
from docketlab.functions import text as T
from docketlab.operators import checks, evidence, graph, liens, merge, pages, reconcile
from docketlab.sources import packets
from docketlab.streaming import decisions

STACK = "packet string, lien string, status string, recorded date, sequence string, kind string"
DAY = dt.date


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


def test_text_keys(spark):
    assert one(spark, "“Deed” of  TRUST!", T.normalize) == "'deed' of trust"
    assert one(spark, "$1,234.5 due", T.money_key) == "1234.50"
    assert one(spark, "recorded 1/2/25", T.date_key) == "2025-01-02"
    assert [one(spark, n, T.ordinal, "int") for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert one(spark, 'a "b"', T.csv_cell) == '"a ""b"""'
    assert one(spark, "12 Main Street", T.address_key) == one(spark, "12 MAIN ST", T.address_key)
    assert one(spark, "Not Stated", T.stated) is None
    assert one(spark, None, T.normalize) == ""
    assert T.bounded("9", 2, 1, 6) == 6 and T.bounded(None, 2, 1, 6) == 2


@pytest.mark.parametrize("text,want", [("PACER docket", "Bankruptcy / PACER"), ("Deed of Trust", "Mortgage / Deed of Trust"), ("Assignment of rents", "Assignment"), ("run sheet", "Run Sheet / Abstractor Sheet"), ("nothing", "Unclassified")])
def test_page_classes(spark, text, want):
    assert one(spark, text, lambda c: T.first_match(F.lower(c), D.PAGE_CLASSES, "Unclassified")) == want


def test_order_type(spark):
    assert one(spark, "x Order Type: Two Owner Search | y", lambda c: pages.order_type(c, D.ORDER_TYPES)) == "Two Owner Search"
    assert one(spark, "nothing", lambda c: pages.order_type(c, D.ORDER_TYPES)) is None


def stack(spark, rows):
    return {r.lien: r for r in liens.lien_stack(spark.createDataFrame([("p", *r) for r in rows], STACK)).collect()}


def test_first_in_time(spark):
    s = stack(spark, [("b", "OPEN", DAY(2025, 1, 2), "2", "Deed of Trust"), ("a", "OPEN", DAY(2024, 12, 15), "1", "Judgment Lien"), ("c", "RELEASED", DAY(2020, 1, 1), "0", "Mortgage")])
    assert (s["a"].label, s["b"].label, s["c"].label) == ("1st Lien", "2nd Lien", "Released")


def test_unknown_status_blocks(spark):
    s = stack(spark, [("m", "OPEN", DAY(2020, 1, 1), "2", "Mortgage"), ("j", "UNKNOWN", DAY(2019, 1, 1), "1", "Judgment")])
    assert s["m"].position is None and s["m"].blocker == "UNKNOWN_STATUS"


def test_same_day_without_sequence(spark):
    s = stack(spark, [("a", "OPEN", DAY(2020, 1, 1), None, "Mortgage"), ("b", "OPEN", DAY(2020, 1, 1), "1", "Mortgage"), ("u", "OPEN", None, "9", "Mortgage")])
    assert s["a"].blocker == s["b"].blocker == "SAME_DAY" and s["u"].blocker == "UNDATED"


def test_lien_classes_and_status(spark):
    kinds = {"Deed of Trust": "SECURITY", "Warranty Deed with Vendor's Lien": None, "Assignment of Mortgage": None, "Release of Lien": None, "Judgment": "OTHER", "First Mortgage": "SECURITY"}
    for k, want in kinds.items():
        assert one(spark, k, liens.lien_class) == want
    status = {"Unreleased": "OPEN", "unpaid": "OPEN", "Released": "RELEASED", "Recorded": "UNKNOWN", "Active": "OPEN", "Satisfied": "RELEASED"}
    for k, want in status.items():
        assert one(spark, k, lambda c: liens.lien_status(c, F.lit(False), F.lit(False))) == want
    assert one(spark, "First Deed of Trust", liens.priority_exception) == ""
    assert one(spark, "IRS lien", liens.priority_exception) == "TAX"


def test_target_and_requirements(spark):
    rows = [("p", "j", "OPEN", DAY(2024, 12, 15), "1", "Judgment Lien"), ("p", "m", "OPEN", DAY(2025, 1, 2), "2", "Deed of Trust"), ("q", "x", "UNKNOWN", None, None, "Mortgage"), ("r", "z", "RELEASED", DAY(2020, 1, 2), "3", "Mortgage")]
    s = liens.lien_stack(spark.createDataFrame(rows, STACK))
    t = liens.automatic_target(s, F.lit(True))
    assert {r.packet: r.target for r in t.collect()} == {"p": "m", "q": None, "r": None}
    got = {(r.packet, r.code) for r in liens.requirements(s, t).collect()}
    assert got == {("p", "SENIOR_j"), ("q", "TARGET_LIEN_SELECTION"), ("q", "LIEN_STATUS_x"), ("r", "TARGET_LIEN_SELECTION")}
    assert {r.packet: r.status for r in liens.analysis(s, t).collect()} == {"p": "REVIEW", "q": "CURATIVE_REQUIRED", "r": "CURATIVE_REQUIRED"}


def test_grounding(spark):
    quotes = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "alpha beta gamma delta epsilon zeta"), (3, "Acme"), (4, "Not Stated")], "quote_id int, quote string")
    texts = spark.createDataFrame([(10, "See: The quick brown fox jumps over"), (11, "alpha beta gamma delta epsilon and more"), (12, "acme corp"), (13, None)], "page_id int, text string")
    found = evidence.grounded(quotes, texts)
    assert {(r.quote_id, r.page_id, r.exact) for r in found.collect()} == {(1, 10, True), (2, 11, False), (3, 12, True)}
    assert {r.quote_id: r.state for r in evidence.evidence_state(quotes, found).collect()} == {1: "CONFIRMED", 2: "CONFIRMED", 3: "CONFIRMED", 4: "NOT_STATED"}


def test_gate_and_guard(spark):
    c = spark.createDataFrame([("PASS", ["e"]), ("FAIL", []), ("PASS", None), ("CANNOT_CONFIRM", [])], "status string, evidence array<string>")
    assert [r.status for r in evidence.gated(c).collect()] == ["PASS", "CANNOT_CONFIRM", "CANNOT_CONFIRM", "CANNOT_CONFIRM"]
    rows = spark.createDataFrame([("p", "a", "PASS", 2), ("p", "b", "PASS", 1), ("p", "b", "PASS", 2), ("p", "c", "FAIL", 2)], "packet string, check_id string, status string, page int")
    bad = spark.createDataFrame([("p", 2)], "packet string, page int")
    assert {r.check_id: r.status for r in checks.integrity_guard(rows, bad).collect()} == {"a": "CANNOT_CONFIRM", "b": "PASS", "c": "FAIL"}


BASE = {
    "packet": "p", "order_type": "Current Owner Search", "owner_state": "CONFIRMED", "deeds": 1, "chain": None, "target": None, "selection_required": False, "target_amount": "100", "target_amount_state": None,
    "target_position_state": "NOT_STATED", "hoa": "Northgate HOA", "hoa_state": "CONFIRMED", "ccrs": "none", "ccrs_state": "CONFIRMED", "hoa_detail": True, "summary_pairs": 2, "summary_detected": True,
    "summary_mismatched": 0, "summary_omitted": 0, "summary_missing": 0, "pair_missing": 0, "amount_or_party_mismatch": 0, "legal_texts": 2, "legal_keys": 1, "mortgages": 1, "mers": "no", "mers_state": "CONFIRMED",
    "mers_party": False, "federal_tax": "None found", "federal_tax_state": "CONFIRMED", "unknown_liens": 0, "released_liens": 0, "releases": 0, "report_address": "1 Main Street", "source_address": "1 MAIN ST", "loan": "m", "loan_recorded": "01/02/2025",
    "loan_status": "OPEN", "min_state": "CONFIRMED", "min_pages": [2], "page_start": 1, "page_end": 3, "sheet_detected": False, "sheet_mismatched": 0, "sheet_omitted": 0, "sheet_missing": 0,
}


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, {"CURRENT_OWNER_ESTABLISHED": "PASS", "PRIOR_OWNER_ESTABLISHED": "CANNOT_CONFIRM", "HOA_NAME_AMOUNTS_REVIEWED": "PASS", "RUN_SHEET_RECONCILES": "PASS", "FEDERAL_TAX_LIEN_REVIEWED": "NOT_APPLICABLE", "MIN_RUN_SHEET_REVIEWED": "NOT_APPLICABLE", "PROPERTY_IDENTITY_RECONCILES": "PASS", "RECOURSE_REVIEWED": "NOT_APPLICABLE"}),
        ({"summary_mismatched": 1}, {"MATERIAL_REPORT_ERRORS_REVIEWED": "FAIL", "RUN_SHEET_RECONCILES": "FAIL", "RECORDED_DOCUMENTS_RECONCILE": "FAIL"}),
        ({"sheet_detected": True, "sheet_mismatched": 1}, {"RUN_SHEET_RECONCILES": "FAIL", "MATERIAL_REPORT_ERRORS_REVIEWED": "PASS"}),
        ({"summary_missing": 1, "pair_missing": 1}, {"RECORDED_DOCUMENTS_RECONCILE": "CANNOT_CONFIRM", "DEED_MORTGAGE_ACCURACY": "CANNOT_CONFIRM"}),
        ({"order_type": "2nd Lien", "chain": False}, {"HOA_STATUS_REVIEWED": "NOT_APPLICABLE", "OWNERSHIP_CHAIN_COMPLETE": "FAIL"}),
        ({"order_type": "foreclosure", "target": "m", "target_amount_state": "CONFIRMED", "target_position_state": "EXAMINER_CONFIRMED"}, {"TARGET_LIEN_FOUND": "PASS", "TARGET_LIEN_AMOUNT": "PASS", "TARGET_LIEN_POSITION_ESTABLISHED": "PASS"}),
        ({"mers": "yes"}, {"MIN_RUN_SHEET_REVIEWED": "PASS", "MERS_BENEFICIARY_REVIEWED": "PASS"}),
        ({"mers": "yes", "min_pages": [9]}, {"MIN_RUN_SHEET_REVIEWED": "CANNOT_CONFIRM"}),
        ({"source_address": "2 MAIN ST", "legal_keys": 2, "unknown_liens": 1}, {"PROPERTY_IDENTITY_RECONCILES": "FAIL", "LEGAL_DESCRIPTION_RECONCILES": "CANNOT_CONFIRM", "RELEASES_RECONCILED": "CANNOT_CONFIRM"}),
    ],
)
def test_checks(spark, change, want):
    row = BASE | change
    names = [c.split()[0] for c in checks.WIDE.split(", ")]
    got = {r.check_id: r.status for r in checks.evaluate(spark.createDataFrame([tuple(row[n] for n in names)], checks.WIDE)).collect()}
    assert {k: got[k] for k in want} == want
    assert set(D.NUMBERED) <= set(got)


def test_profiles(spark):
    names = [c.split()[0] for c in checks.WIDE.split(", ")]
    sizes = {}
    for kind in ("One Owner Search", "Foreclosure", "Not Stated", None):
        row = BASE | {"order_type": kind}
        sizes[kind] = checks.evaluate(spark.createDataFrame([tuple(row[n] for n in names)], checks.WIDE)).count()
    assert sizes == {"One Owner Search": 21, "Foreclosure": 25, "Not Stated": 21, None: 21}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["PASS", "FAIL", "CANNOT_CONFIRM", "NOT_APPLICABLE"]), min_size=1, max_size=8))
def test_reduction_ladder(spark, statuses):
    got = checks.reduced(spark.createDataFrame([("p", s) for s in statuses], "packet string, status string"), ["packet"]).first()
    assert got.qc_status == ("REVIEW" if "CANNOT_CONFIRM" in statuses else "FAIL" if "FAIL" in statuses else "PASS")


def test_merge(spark):
    v = spark.createDataFrame([("k", "Deed", 1), ("k", "DEED.", 2), ("k", "Mortgage", 3), ("k", "Unknown", 4), ("j", "N/A", 1)], "key string, value string, pos int")
    assert [(r.key, r.value, r.n) for r in merge.majority(v).collect()] == [("k", "Deed", 2)]
    f = spark.createDataFrame([("k", "A", "e1", 0.9), ("k", "B", "e2", 0.85), ("m", "A", "e1", 0.9), ("m", "B", "e2", 0.7)], "key string, value string, evidence string, confidence double")
    assert {r.key: r.value for r in merge.best_fact(f).collect()} == {"k": "Needs review", "m": "A"}


def test_reconcile_types_and_parties(spark):
    df = spark.createDataFrame([("Warranty Deed", "Deed of Trust", True), ("Plat", "Judgment", False), ("", "Judgment", True)], "a string, b string, want boolean")
    assert df.where(reconcile.type_compatible(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("John Adam Smith", "JOHN SMITH JR", True), ("John Adam Smith", "Mary Smith", False), ("", "x", True)], "a string, b string, want boolean")
    assert df.where(reconcile.party_overlap(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_greedy_takes_each_source_once(spark):
    e = spark.createDataFrame([(1, 1, 100.0), (1, 2, 100.0)], "packet long, entry long, amount double")
    s = spark.createDataFrame([(1, 7, 100.0)], "packet long, source long, amount double")
    assert [(r.entry, r.source) for r in reconcile.greedy(e, s, 0.1).orderBy("entry").collect()] == [(1, 7), (2, None)]


def test_shards_against_a_loop(spark):
    import random

    random.seed(4)
    sizes = [random.randint(0, 900) for _ in range(60)]
    want, held, chars, n = [], [], 0, 0
    for p, c in enumerate(sizes, 1):
        size = c + 150
        if held and (len(held) >= 5 or sum(x[1] for x in held) + size > 3000):
            n += 1
            held = held[-2:]
            want += [(q, n) for q, _ in held]
        held.append((p, size))
        want.append((p, n))
    df = spark.createDataFrame([("k", p, c) for p, c in enumerate(sizes, 1)], "packet string, page long, char_count long")
    assert sorted((r.page, r.shard) for r in pages.shards(df, 5, 3000, 2).collect()) == sorted(want)


def test_shards_gather_no_packet(spark):
    """Two packets: pages stream by in order, and no array holds a packet's pages."""
    out = pages.shards(spark.createDataFrame([("a", p, 0) for p in range(7)] + [("b", 1, 0)], "packet string, page long, char_count long"), 3, 3000, 1)
    assert sorted((r.packet, r.page, r.shard) for r in out.collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 1), ("a", 4, 2), ("a", 5, 2), ("a", 6, 2), ("b", 1, 0)]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_stages(spark):
    log = spark.createDataFrame([("a", i, s) for i, s in enumerate(D.STAGES[1:])] + [("b", 0, "EXTRACT"), ("c", 0, "INGEST"), ("c", 1, "FAILED")], "key string, seq int, stage string")
    assert [(r.key, r.stage) for r in graph.illegal_steps(log).collect()] == [("b", "EXTRACT")]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", None), (2, 'say "x"', "Needs review")], "key int, owner string, position string")
    cols = {"owner": F.col("owner"), "position": F.col("position")}
    assert [r.line for r in graph.export_lines(rows, cols).orderBy("key").collect()] == ['"a\nb",""', '"say ""x""","Needs review"']
    assert {(r.key, r.field) for r in graph.export_warnings(rows, cols).collect()} == {(1, "position"), (2, "position")}
    packets.write_lines(graph.export_lines(rows.where("key = 1"), cols).coalesce(1), str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part*")) == b'"a\nb",""\r\n'


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.pdf").write_bytes(b"")
    assert packets.landing(spark, str(tmp_path)).where("path like '%a.pdf'").count() == 1
    ok, bad = packets.validated(spark.createDataFrame([("x.pdf", 4), ("y.PDF", 0), ("z.txt", 9)], "path string, length bigint"))
    assert ok.count() == 1 and {r.path: r.reason for r in bad.collect()} == {"y.PDF": "EMPTY_PACKET", "z.txt": "WRONG_TYPE"}
    cache = spark.createDataFrame([("h", 4), ("old", 3)], "packet_hash string, version int")
    todo = spark.createDataFrame([("h",), ("old",), ("new",)], "packet_hash string")
    assert sorted(r.packet_hash for r in packets.to_scan(todo, cache).collect()) == ["new", "old"]
    asked = packets.requested_pages(spark.createDataFrame([("r", "3, 1,x,3,0")], "request string, pages string"), 1)
    assert sorted((r.page, r.processed) for r in asked.collect()) == [(1, True), (3, False)]
    out = packets.model_output(spark.createDataFrame([('{"value":"x"}',)], "json string"), "value string")
    assert out.first().parsed.value == "x"


def test_streaming_matches_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decisions.latest_decisions(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "out").iterdir())
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out" / f"v{last}")).collect()}
    want = {r.event_id for r in checks.latest(src, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).collect()}
    assert got == want


def test_streaming_deltas_survive_replays_and_gaps(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    decisions.decision_deltas(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = sorted(r.event_id for r in checks.latest(src, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).collect())
    assert sorted(r.event_id for r in decisions.current(spark, str(tmp_path / "out")).collect()) == want
    decisions.decision_deltas(stream, str(tmp_path / "out"), str(tmp_path / "ck-lost")).awaitTermination()  # all batches again
    (tmp_path / "out" / "epoch=0").rename(tmp_path / "out" / "epoch=77")  # epochs with a gap
    assert sorted(r.event_id for r in decisions.current(spark, str(tmp_path / "out")).collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_candidates_hold_several_rare_tokens(spark):
    asked = spark.createDataFrame([(1, 6, i, t) for i, t in enumerate("alpha beta gamma delta epsilon zeta".split())], "quote_id int, n int, i int, t string")
    words = spark.createDataFrame([(p, t) for p, held in ((10, "alpha"), (11, "alpha beta"), (12, "alpha beta gamma zeta")) for t in held.split()], "page_id int, t string")
    assert {(r.quote_id, r.page_id) for r in evidence._candidates(asked, words, evidence.RATIO).collect()} == {(1, 12)}


def test_order_type_makes_opening_and_label_once(spark):
    texts = spark.createDataFrame([("Order Type: Full Search | deed",), ("a deed",), ("none",), (None,)], "text string")
    found = texts.select(pages.order_type(F.col("text"), [("Deed", "deed"), ("Full", "(?i)full")]).alias("x"))
    assert [r.x for r in found.collect()] == ["Full", "Deed", None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
