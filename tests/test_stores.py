"""Batch manifests replayed from their log, and stores whose probes read only their own partitions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docketlab.sources import keyed, manifests


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


BATCHES = "batch string, client string, profile string, at timestamp, files array<string>"
PATCHES = "batch string, item string, at timestamp, id string, version long, fields map<string,string>"


@pytest.fixture(scope="module")
def made(spark):
    return manifests.created(spark.createDataFrame([("b1", " ", "p", at(0), ["x.pdf", "y.pdf", "x.pdf"]), ("b2", "Acme", "p", at(0), [])], BATCHES))


def test_creation_and_blank_client(made):
    rows = manifests.items(made).collect()
    assert sorted(r.source_file for r in rows) == ["x.pdf", "x.pdf", "y.pdf"] and {r.status for r in rows} == {"QUEUED"} and {r.client for r in rows} == {"Client"}
    again = manifests.items(made.unionByName(made)).collect()  # a creation that ran twice
    assert len(again) == 3 and {(r.version, r.stale) for r in again} == {(0, 0)}


def test_concurrent_patches_replay_to_one_state(spark, made):
    ids = [r.item for r in made.orderBy("item").collect()]
    r = random.Random(4)
    rows = [("b1", r.choice(ids), at(r.randint(1, 5)), f"w{i:03d}", r.randint(0, 3), {k: r.choice(["A", "B", None]) for k in r.sample(["status", "review", "error", "source_file", "junk"], 2)}) for i in range(60)]
    want = {i: {"status": "QUEUED", "review": None, "error": None, "packet_hash": None} for i in ids}
    version, stale = dict.fromkeys(ids, 0), dict.fromkeys(ids, 0)
    for _, item, _, _, read, fields in sorted(rows, key=lambda x: (x[2], x[3])):
        want[item] |= {k: v for k, v in fields.items() if k in manifests.FIELDS}
        stale[item] += read < version[item]
        version[item] += 1
    states = set()
    for order in range(3):  # files of the log in any order, parts repeated
        r.shuffle(rows)
        log = made.unionByName(manifests.patched(spark.createDataFrame(rows + rows[:7], PATCHES)))
        got = {x.item: x for x in manifests.items(log.repartition(3 + order)).collect()}
        assert {i: {k: got[i][k] for k in want[i]} for i in ids} == want
        assert {i: (got[i].version, got[i].stale) for i in ids} == {i: (version[i], stale[i]) for i in ids}
        states.add(str(sorted(map(tuple, got.values()))))
    assert len(states) == 1
    small = manifests.compacted(log)
    again = {x.item: x for x in manifests.items(small).collect()}
    assert {i: {k: again[i][k] for k in want[i]} for i in ids} == want and small.count() <= 2 * len(ids)


def test_patches_without_an_item_are_refused(spark, made):
    lost = spark.createDataFrame([("b1", "nobody", at(1), "1", 0, {"status": "ERROR"}), ("b9", "nobody", at(1), "2", 0, {})], PATCHES)
    log = made.unionByName(manifests.patched(lost))
    assert {(r.id, r.reason) for r in manifests.refused(log).collect()} == {("1", "Batch item was not found."), ("2", "Batch manifest was not found.")}
    assert manifests.items(log).count() == 3
    assert [(r.batch, r.items, r.queued) for r in manifests.manifests(log).collect()] == [("b1", 3, 3)]


def test_index_reads_its_own_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    keyed.put(spark.range(2000).select(F.concat(F.lit("order-"), F.col("id") % 500).alias("identity"), F.concat(F.lit("r"), F.col("id") % 1000).alias("review")), path, "identity")
    keyed.put(spark.createDataFrame([("order-7", "r7"), ("order-7", "new")], "identity string, review string"), path, "identity")  # a later review
    asked = spark.createDataFrame([("m1", "order-7"), ("m1", "order-8"), ("m2", "parcel-none"), ("m3", None)], "key string, identity string")
    got = {r.key: r.revision for r in keyed.indexed_reviews(spark, path, asked).collect()}
    assert got == {"m1": 1 + len({"r7", "r507", "new", "r8", "r508"}), "m2": 1, "m3": 1}
    plan = keyed.take(spark, path, asked, "identity")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shelf" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    read = keyed.take(spark, path, asked, "identity").inputFiles()
    assert 0 < len({f.split("shelf=")[1][:2] for f in spark.read.parquet(path).inputFiles()}) and len({f.split("shelf=")[1][:2] for f in read}) <= 256


def test_dossiers_are_the_last_of_each_review(spark, tmp_path):
    path = str(tmp_path / "dossiers")
    keyed.put(spark.createDataFrame([("r1", at(1), "old"), ("r1", at(2), "new"), ("r2", at(1), "other")], "review string, at timestamp, body string"), path, "review")
    got = keyed.dossiers(spark, path, spark.createDataFrame([("r1",), ("r9",)], "review string")).collect()
    assert [(r.review, r.body) for r in got] == [("r1", "new")]
    assert keyed.dossiers(spark, path, spark.createDataFrame([], "review string")).collect() == []
