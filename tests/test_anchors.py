"""Anchors of nested extractions against a walk over Python values."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docketlab.operators import anchors

A = "array<struct<page:int,kind:string,number:string,quote:string,confidence:double>>"
RAW = f"header struct<owner:struct<value:string,evidence:{A}>>, deep array<array<struct<name:string,evidence:{A},inner:struct<more:array<struct<evidence:{A}>>>>>>, notes array<string>, evidence {A}, plain string"


def anchor(page, quote, kind=None, number=None, confidence=None):
    return {"page": page, "kind": kind, "number": number, "quote": quote, "confidence": confidence}


FULL = {
    "header": {"owner": {"value": "Jo", "evidence": [anchor(1, "One quote", "Deed", "7", 0.4)]}},
    "deep": [[{"name": "x", "evidence": None, "inner": {"more": [{"evidence": [anchor(2, "two", confidence=9.0), anchor(0, "no page")]}, None]}}, None], None, [], [{"name": "y", "evidence": [anchor(1, "ONE  quote!", "deed", "7", 0.9)], "inner": None}]],
    "notes": ["n"],
    "evidence": [anchor(3, " "), anchor(3, None), anchor(4, "four", confidence=float("nan"))],
    "plain": "p",
}
EMPTY = {"header": None, "deep": None, "notes": None, "evidence": None, "plain": None}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([("a", FULL), ("b", EMPTY), ("c", {**EMPTY, "header": {"owner": None}, "deep": [], "evidence": []})], f"packet string, raw struct<{', '.join(re.sub(r'^(\w+) ', r'\1:', f) for f in RAW.split(', '))}>")


def walk(value, path=""):
    """All anchors with their places, in order."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k == "evidence":
                yield from ((f"{path}.{k}[{i}]"[1:], a) for i, a in enumerate(v or []))
            else:
                yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def test_collected_at_any_depth(raw):
    got = anchors.collected(raw).orderBy("packet", "seq").collect()
    assert [(r.packet, r.path, r.anchor.page, r.anchor.quote) for r in got] == [("a", p, x["page"], x["quote"]) for p, x in walk(FULL)]
    assert [r.seq for r in got] == list(range(len(got)))


def test_ledger_has_each_anchor_once(raw):
    got = {r.page: r for r in anchors.ledger(anchors.collected(raw)).collect()}
    assert set(got) == {1, 2, 4}  # no page 0, no blank quote
    assert (got[1].quote, got[1].kind, got[1].number, got[1].confidence, got[1].places) == ("One quote", "Deed", "7", 0.4, 2)
    assert (got[2].kind, got[2].number, got[2].confidence) == ("Unclassified", None, 1.0) and got[4].confidence == 0.5
    norm = lambda x: re.sub("[^a-z0-9$#./'-]+", " ", x.lower()).strip()
    assert got[1].id == "ev_" + hashlib.sha256(f"a|1|{norm('Deed')}|7|{norm('One quote')}".encode()).hexdigest()[:20]


def test_ids_in_their_places(raw):
    ids = {r.page: r.id for r in anchors.ledger(anchors.collected(raw)).collect()}
    out = {r.packet: r.raw for r in anchors.with_ids(raw).collect()}
    a = out["a"]
    assert a.header.owner.evidence_ids == a.deep[3][0].evidence_ids == [ids[1]] and a.header.owner.value == "Jo"
    assert a.deep[0][0].inner.more[0].evidence_ids == [ids[2]] and a.deep[0][0].inner.more[1] is None and a.deep[0][0].evidence_ids == []
    assert a.deep[0][1] is None and a.deep[1] is None and a.evidence_ids == [ids[4]] and a.plain == "p" and a.notes == ["n"]
    assert out["b"].header is None and out["b"].deep is None and out["c"].header.owner is None


def test_verified_on_their_own_page_alone(spark, raw):
    pages = spark.createDataFrame([("a", 1, "Here: one QUOTE.", None, False), ("a", 2, "two", "tesseract", False), ("a", 4, "four", "native", True), ("z", 1, "one quote", None, False)], "packet string, page int, text string, source string, unseen boolean")
    nodes = anchors.verified(anchors.ledger(anchors.collected(raw)), pages)
    got = {r.page: (r.text_verified, r.source, r.native) for r in nodes.collect()}
    assert got == {1: (True, "native", True), 2: (True, "tesseract", False), 4: (False, None, False)}
    owners = nodes.select("packet", F.col("page").cast("string").alias("key"), "id").unionByName(spark.createDataFrame([("a", "none", None)], "packet string, key string, id string"))
    assert {r.key: r.state for r in anchors.confirmed(nodes, owners).collect()} == {"1": "CONFIRMED", "2": "UNCONFIRMED", "4": "UNCONFIRMED", "none": "NOT_STATED"}
    assert anchors.by_ids(nodes, owners.where("key = '2'")).count() == 1


def test_contained(spark):
    rows = [("one two three four", "x one two three four y", True), ("one two three four five", "one two three four z", False), ("aa bb cc dd ee ff", "aa bb cc dd ee zz", True), ("aa bb cc", "aa bb zz", False), ("", "x", False), ("x y", "", False)]
    df = spark.createDataFrame(rows, "q string, p string, want boolean")
    assert all(r.want == r.got for r in df.select("want", anchors.contained(F.col("q"), F.col("p")).alias("got")).collect())


def test_nothing_to_collect(spark, raw):
    assert anchors.collected(raw.limit(0)).collect() == []
    bare = spark.createDataFrame([("a", ("x",))], "packet string, raw struct<name:string>")
    assert anchors.collected(bare).collect() == [] and anchors.with_ids(bare).first().raw.name == "x"
