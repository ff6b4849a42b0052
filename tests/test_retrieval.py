"""Retrieval: words that meet tokens in place or by a shuffle, and pages counted where they are."""

import random

from docketlab.operators import graph, retrieval


def _rows(spark):
    r = random.Random(5)
    words = ["deed", "deeds", "mortgage", "mortgages", "trust", "trustee", "line", "release", "xyz"]
    text = lambda n: " ".join(r.choices(words, k=n))
    pages = [(i % 3, i, r.choice(["Deed", None]), text(r.choice([0, 5, 40])), i % 7 == 0, i % 5 == 0) for i in range(60)]
    evidence = [(i % 3, i, i, "Deed", None, text(3)) for i in range(0, 60, 4)]
    asked = [(i % 3, i, f"What of page {i * 4}? {text(2)}") for i in range(9)]
    return (
        spark.createDataFrame(asked, "packet long, question long, text string"),
        spark.createDataFrame(pages, "packet long, page long, hint string, text string, blank boolean, unseen boolean"),
        spark.createDataFrame(evidence, "packet long, page long, id long, kind string, number string, quote string"),
    )


def _moved(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_pairs_sent_and_pairs_joined_say_the_same(spark):
    q, pages, evidence = _rows(spark)
    sent, joined = (retrieval.top_pages(q, pages, evidence, 5, sent=n) for n in (retrieval.SENT, 0))
    got = sorted(map(tuple, sent.collect()))
    assert got == sorted(map(tuple, joined.collect())) and len(got) == 45
    by_page = lambda df: [m for m in _moved(df) if "word" in m and "page" in m and "id#" not in m]
    assert not by_page(sent) and by_page(joined)


def test_counts_of_a_page_move_once(spark):
    q, pages, _ = _rows(spark)
    top = graph.top_pages(q.drop("packet"), pages.select("page", "text"))
    assert top.where("rank = 1").count() == 9
    assert sum("page" in m for m in _moved(top)) == 1
