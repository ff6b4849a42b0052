"""Merging of extractions against loops over random rows, and groups in which nothing is stated."""

import random
import re
from collections import Counter, defaultdict

import pytest

from docketlab.operators import extractions as X
from docketlab.operators import merge
from docketlab.plans import catalogue_extractions as C

SCHEMA = f"packet string, pos long, {', '.join(f'{f} string' for f in X.FIELDS)}, category string, description string, parties array<struct<name:string,role:string>>, refs array<string>, evidence array<{X.ANCHOR}>"
MISSING = {"", "NOT STATED", "NEEDS REVIEW", "UNKNOWN", "NOT PROVIDED", "N A", "NA"}


def norm(x):
    return re.sub("[^A-Z0-9]+", " ", (x or "").upper()).strip(" ")


def gone(x):
    return norm(x) in MISSING


def best(values):
    counts = {}
    for v in values:
        if not gone(v):
            first, n = counts.get(norm(v), (v, 0))
            counts[norm(v)] = (first, n + 1)
    return sorted(counts.values(), key=lambda c: (-c[1], -len(c[0])))[0][0] if counts else "Not Stated"


def unique_anchors(anchors):
    seen, out = set(), []
    for a in anchors:
        key = (a["page"], norm(a["kind"]), norm(a["number"]), norm(a["quote"]))
        if key not in seen:
            seen.add(key)
            out.append(a)
    return sorted(out, key=lambda a: (a["page"], -a["confidence"]))


def key_of(r):
    pages = [a["page"] for a in r["evidence"] or [] if a["page"] > 0]
    if not gone(r["number"]):
        return f"NUM:{norm(r['number'])}"
    if not gone(r["book_page"]):
        return f"BOOK:{norm(r['kind'])}:{norm(r['book_page'])}"
    return f"PAGE:{norm(r['kind'])}:{min(pages, default=0)}:{norm(r['documented'])}"


@pytest.fixture(scope="module")
def said():
    r = random.Random(8)
    anchor = lambda: {"page": r.randint(0, 3), "kind": r.choice(["Deed", "deed.", None]), "number": None, "quote": r.choice(["The quote", "the  QUOTE!", "other"]), "confidence": r.choice([0.5, 0.9])}
    rows = []
    for pos in range(400):
        row = {f: r.choice([None, "", "n/a", "Needs review", "A b", "a  B.", "A B C", "zz"]) for f in X.FIELDS}
        row |= {"number": r.choice([None, "NA", "", "No 1", "no. 1", "2"]), "book_page": r.choice([None, "unknown", "B 1"]), "packet": r.choice("pqr"), "pos": pos, "category": r.choice(["Deeds", "deeds", None]), "description": r.choice(["x", "X ", None])}
        row["parties"] = r.choice([None, [], [{"name": "Jo", "role": "Grantor"}, {"name": "JO ", "role": "grantor"}], [{"name": "Al", "role": None}]])
        row["refs"] = r.choice([None, [], ["7", "n/a", None, "7", "8"], ["8"]])
        row["evidence"] = r.choice([None, [], [anchor(), anchor()], [anchor()]])
        rows.append(row)
    return rows


def plain_anchor(a):
    return (a["page"], a["kind"], a["number"], a["quote"], a["confidence"])


def test_instruments_equal_a_loop(spark, said):
    groups = defaultdict(list)
    for r in said:
        groups[r["packet"], key_of(r)].append(r)
    want = {}
    for k, rs in groups.items():
        parties, refs = {}, []
        for r in rs:
            for p in r["parties"] or []:
                parties.setdefault((norm(p["role"]), norm(p["name"])), (p["name"], p["role"]))
            refs += [x for x in r["refs"] or [] if not gone(x)]
        want[k] = (*(best([r[f] for r in rs]) for f in X.FIELDS), len(rs), list(parties.values()), list(dict.fromkeys(refs)), [plain_anchor(a) for a in unique_anchors([a for r in rs for a in r["evidence"] or []])])
    got = X.merge_instruments(spark.createDataFrame(said, SCHEMA)).collect()
    made = {(r.packet, r.key): (*(r[f] for f in X.FIELDS), r.n, [tuple(p) for p in r.parties], r.refs, [plain_anchor(a) for a in r.evidence]) for r in got}
    assert [(k, x, y) for k in want for x, y in zip(made[k], want[k], strict=True) if x != y] == []
    assert len(got) == len(want)


def test_entries_equal_a_fold(spark, said):
    rows = [r | {"parties": (r["parties"] or [{"name": None}])[0]["name"]} for r in said]
    held = {}
    for r in rows:
        page = r["evidence"][0]["page"] if r["evidence"] else 0
        key = (r["packet"], f"NUM:{norm(r['number'])}:{norm(r['category'])}" if not gone(r["number"]) else "|".join([norm(r["category"]), norm(r["kind"]), norm(r["book_page"]), str(page)]))
        before = held.get(key)
        if before is None:
            held[key] = {f: r[f] for f in X.ENTRY_FIELDS} | {"evidence": unique_anchors(r["evidence"] or [])}
        else:
            held[key] = {f: best([before[f], r[f]]) for f in X.ENTRY_FIELDS} | {"evidence": unique_anchors(before["evidence"] + (r["evidence"] or []))}
    schema = SCHEMA.replace("parties array<struct<name:string,role:string>>", "parties string")
    got = X.merge_entries(spark.createDataFrame(rows, schema)).collect()
    assert {(r.packet, r.key): {f: r[f] for f in X.ENTRY_FIELDS} for r in got} == {k: {f: v[f] for f in X.ENTRY_FIELDS} for k, v in held.items()}
    anchors = lambda e: Counter(map(plain_anchor, e))
    assert all(anchors(r.evidence) == anchors(held[r.packet, r.key]["evidence"]) for r in got)


def test_references_keep_the_first(spark, said):
    groups = defaultdict(list)
    for r in said:
        groups[r["packet"], "|".join(norm(r[f]) for f in ("kind", "number", "book_page", "description"))].append(r)
    got = {(r.packet, r.key): r for r in X.merge_references(spark.createDataFrame(said, SCHEMA)).collect()}
    assert got.keys() == groups.keys()
    for k, rs in groups.items():
        assert (got[k].pos, got[k].kind, got[k].description) == (rs[0]["pos"], rs[0]["kind"], rs[0]["description"])
        assert [plain_anchor(a) for a in got[k].evidence] == [plain_anchor(a) for a in unique_anchors([a for r in rs for a in r["evidence"] or []])]


def test_nothing_and_bounds(spark, said):
    none = spark.createDataFrame([], SCHEMA)
    assert X.merge_instruments(none).collect() == X.merge_references(none).collect() == []
    parts = spark.createDataFrame([("a", True, 0, 9), ("a", True, 4, 0), ("a", False, 1, 99), ("b", False, 1, 2), ("c", None, None, None), ("d", True, None, 0)], "packet string, detected boolean, page_start int, page_end int")
    assert {r.packet: (r.detected, r.page_start, r.page_end) for r in X.summary_bounds(parts).collect()} == {"a": (True, 4, 9), "b": (False, 0, 0), "c": (False, 0, 0), "d": (True, 0, 0)}


def test_merge_rows_meets_spellings_and_keeps_bare_keys(spark):
    rows = spark.createDataFrame([("k", 1, "ACME Bank", None), ("k", 2, "acme  bank.", None), ("k", 3, "Zed", "n/a"), ("k", 4, "Zed Ltd", "x"), ("bare", 1, None, None), ("bare", 2, "Unknown", "")], "key string, pos int, name string, other string")
    got = {r.key: (r.name, r.other, r.n) for r in merge.merge_rows(rows, "key", ["name", "other"]).collect()}
    assert got == {"k": ("ACME Bank", "x", 4), "bare": (None, None, 2)}


def moves(df):
    """How often rows are moved, and whether any are exploded before."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), "Generate explode" in plan[plan.index("Exchange hashpartitioning") :]


def test_merged_instruments_move_whole_rows_once(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert moves(X.merge_instruments(rows)) == (1, False)


def test_merge_rows_moves_whole_rows_once(spark):
    rows = spark.createDataFrame([], "key int, pos long, name string, other string")
    assert moves(merge.merge_rows(rows, "key", ["name", "other"])) == (1, False)


def test_gathered_and_counted_groups_say_the_same(spark):
    rows = C._rows(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, X.merge_instruments(rows).collect()))
    for gathered in (0, 3):
        assert sorted(map(str, X.merge_instruments(rows, gathered).collect())) == want


def test_rows_of_one_pos_follow_by_what_they_say(spark):
    schema = "packet long, pos long, " + ", ".join(f"{f} string" for f in X.FIELDS) + f", parties array<struct<name:string,role:string>>, refs array<string>, evidence array<{X.ANCHOR}>"
    row = lambda status, name, quote: (1, 5, "Deed", "7", *[None] * 4, status, None, None, [(name, "Grantor")], [name], [(1, None, None, quote, 0.5)])
    given = [row("OPEN", "Jo", "A b"), row("open", "JO", "a  B"), row("Paid", "Ann", "c")]
    for gathered in (0, 1000):
        made = [X.merge_instruments(spark.createDataFrame(g, schema).coalesce(1), gathered).collect() for g in (given, given[::-1])]
        assert made[0] == made[1] and made[0][0].status == "OPEN" and [p.name for p in made[0][0].parties] == ["Ann", "JO"]
        assert made[0][0].refs == ["Ann", "JO", "Jo"] and [a.quote for a in made[0][0].evidence] == ["A b", "c"]
