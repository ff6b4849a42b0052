"""The part of an evidence graph that a question takes, against a loop; reference resolution on awkward rows."""

import random

from pyspark.sql import functions as F

from docketlab.operators import evidence_graph as G


def loop(tokens, nodes, edges):
    """The reading of the rule as a loop: best nodes, edges at them, ends filled in edge by edge."""
    score = lambda n: sum((2 if len(t) > 7 else 1) for t in tokens if t in f"{n[1]} {n[2]}".lower())
    seeds = [n[0] for n in sorted(nodes, key=lambda n: (-score(n), n[0])) if score(n) > 0][:16]
    near = [e for e in sorted(edges) if e[1] in seeds or e[2] in seeds][:48]
    picked, ids = list(seeds), {n[0] for n in nodes}
    for _, a, b in near:
        for end in (a, b):
            if end in ids and end not in picked and len(picked) < 28:
                picked.append(end)
    return picked, [e[0] for e in near]


def test_relevant_equals_a_loop(spark):
    r = random.Random(3)
    words = ["deed", "mortgage", "release", "judgment", "street", "assignment"]
    rows, links, want, asked = [], [], {}, []
    for p in range(25):
        nodes = [(f"n{i:03d}", r.choice(["PARTY", "CHECK"]), " ".join(r.sample(words, 2))) for i in range(r.choice([0, 3, 40, 70]))]
        ids = [n[0] for n in nodes] + ["gone"]
        edges = [(f"e{i:03d}", r.choice(ids), r.choice(ids)) for i in range(r.choice([0, 5, 90]))] if nodes else []
        rows += [(p, i, t, label, {}, []) for i, t, label in nodes]
        links += [(p, *e) for e in edges]
        for q in range(2):
            tokens = r.sample([*words, "party", "zzz"], 2)
            asked.append((p * 10 + q, p, tokens))
            want[p * 10 + q] = loop(tokens, nodes, edges)
    nodes = spark.createDataFrame(rows, "packet long, id string, type string, label string, attributes map<string,string>, evidence array<string>")
    edges = spark.createDataFrame(links, "packet long, id string, src string, dst string")
    a, b = G.relevant(spark.createDataFrame(asked, "question long, packet long, tokens array<string>"), nodes, edges)
    got_nodes, got_edges = {}, {}
    for r in a.orderBy("place").collect():
        got_nodes.setdefault(r.question, []).append(r.id)
    for r in b.orderBy("place").collect():
        got_edges.setdefault(r.question, []).append(r.id)
    assert {q: (got_nodes.get(q, []), got_edges.get(q, [])) for q in want} == want
    assert max(map(len, got_nodes.values())) == 28 and max(map(len, got_edges.values())) == 48


def test_references_go_to_the_last_instrument_or_outside(spark):
    instruments = spark.createDataFrame([("p", "a", 1, "No. 7", ["e"]), ("p", "b", 2, "no 7", ["f"]), ("p", "c", 3, "--", None), ("q", "d", 1, None, ["g"])], "packet string, instrument string, pos int, number string, evidence array<string>")
    references = spark.createDataFrame([("p", "a", "NO-7"), ("p", "c", "No 8"), ("q", "d", "no. 8"), ("q", "d", "no 7"), ("p", "c", None), ("p", "c", "!"), ("p", "unknown", "7")], "packet string, instrument string, reference string")
    got = {(r.packet, r.instrument, r.reference): (r.target, r.external) for r in G.resolved_references(instruments, references).collect()}
    assert got["p", "a", "NO-7"] == ("instrument_b", False)
    assert got["p", "c", "No 8"][1] and got["p", "c", "No 8"][0] == got["q", "d", "no. 8"][0] != got["q", "d", "no 7"][0]
    assert len(got) == 4


def test_ids_of_evidence_are_sorted_once_each(spark):
    df = spark.createDataFrame([(["b", None, "", "a", "b"],), (None,), ([],)], "ids array<string>")
    assert [r.u for r in df.select(G.unique(df["ids"]).alias("u")).collect()] == [["a", "b"], [], []]


def test_a_graph_moves_rows_by_packet_alone(spark):
    from docketlab.plans import catalogue_graph as C

    for name in ("title_graph_edges", "relevant_graph_edges", "relevant_graph_nodes"):
        plan = C.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert moved and all("REPARTITION" in line for line in moved), moved


def test_null_keys_meet_no_fact(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("p", None, 2), ("q", "a", 3), (None, "a", 4)], "packet string, k string, n int")
    facts = spark.createDataFrame([("p", "a", None), ("p", "a", 7), ("p", None, 8), (None, "a", 9)], "packet string, k string, v int")
    got = {r.n: sorted([x.v for x in r.found], key=str) for r in G.beside(rows, facts, "k", "found").collect()}
    assert got == {1: [7, None], 2: [], 3: [], 4: []}


def test_a_questions_graph_is_made_once(spark):
    i = F.col("id").cast("string")
    nodes = spark.range(7777).select((F.col("id") % 9).alias("packet"), F.concat(F.lit("n"), i).alias("id"), F.lit("DEED").alias("type"), i.alias("label"), F.create_map(F.lit("k"), i).alias("attributes"))
    edges = spark.range(8888).select((F.col("id") % 9).alias("packet"), F.concat(F.lit("e"), i).alias("id"), F.concat(F.lit("n"), i).alias("src"), F.concat(F.lit("n"), (F.col("id") + 9).cast("string")).alias("dst"))
    asked = spark.range(9).select(F.col("id").alias("question"), F.col("id").alias("packet"), F.array(F.lit("deed")).alias("tokens"))
    taken, _ = G.relevant(asked, nodes, edges)
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 7777") == plan.count("Range (0, 8888") == 1
    # ends that no node stands for take no place
    assert taken.join(nodes.select("packet", "id"), ["packet", "id"], "left_anti").count() == 0
