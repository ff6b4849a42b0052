"""Training-data operators against brute force, exact libraries, held-out data and awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlab.llm import bpe, components, fingerprints, language_model, lines, mixing, neighbours, pii, quality, shingles, toxicity
from docketlab.llm.common import mix64, words

DIR = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"
DOC = "doc_id long, text string, lang string, source string, n_chars long, _k string, h long, rank int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, long), (6, long), (None, "no id here at all today"), (None, None), (7, "a" * 50_000), (8, "Ünïcode ß 漢字 \U0001f600 text")]
    return spark.createDataFrame([(i, t, None, None if i == 4 else "s", None, "x", 1, 2) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_words_equal_the_pattern():
    random.seed(1)
    rows = ["".join(random.choice("aAbZ é\t\n\x0b\x0c\r ,") for _ in range(random.randint(0, 30))) for _ in range(200)]
    raw = [r.encode() for r in rows]
    off = np.r_[0, np.cumsum([len(r) for r in raw])]
    start, end, row, h = words(np.frombuffer(b"".join(raw), np.uint8), off)
    data = b"".join(raw)
    got = [[] for _ in rows]
    for s, e, r in zip(start, end, row, strict=True):
        got[r].append(lower(data[s:e].decode()))
    assert got == [re.findall(WORD, lower(r)) for r in rows]
    by = collections.defaultdict(set)
    for s, e, x in zip(start, end, h, strict=True):
        by[lower(data[s:e].decode())].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({v for s in by.values() for v in s}) == len(by)


def test_fingerprints(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = collections.defaultdict(set)
    for i, t in texts.items():
        prints[t].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.8
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_likeness_is_near_jaccard_and_has_no_switch(spark):
    """Neighbours that differ in some words, with 0 to 12 terms in the lexicon: the mean estimate is near the mean of the
    set likeness, whatever the number of lexicon terms."""
    random.seed(11)
    rows, want, k = [], {}, 0
    common = [f"c{i}" for i in range(60)]  # in every text: out of the band
    for n in range(13):
        for _ in range(6):
            rare = [f"r{k}x{i}" for i in range(n)]
            a = common + rare
            b = common[:-1] + [f"new{k}"] + rare + ([f"one{k}"] if n == 7 else [])
            # rows go in descending id: a, then b; filler rows stand between the pairs
            rows += [(4000 - 4 * k, " ".join(a)), (4000 - 4 * k - 1, " ".join(b)), (4000 - 4 * k - 2, f"filler{k} " * 3), (4000 - 4 * k - 3, f"other{k}")]
            want[4000 - 4 * k] = (n, len(set(a) & set(b)) / len(set(a) | set(b)))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprints(docs, least=2 / len(rows)).collect()}
    for n in range(13):
        ids = [i for i, (m, _) in want.items() if m == n]
        near = np.mean([got[i] for i in ids])
        # lexicon terms are those of two rows: the shared rare ones, so their likeness is near 1
        assert near > np.mean([want[i][1] for i in ids]) - 0.15, n
    assert min(got[i] for i in want) > 0.5


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == odd.count()
    same = [r.fingerprint for r in got if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    assert fingerprints.fingerprints(none).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton(spark):
    random.seed(2)
    rows = []
    for _ in range(200):
        a = "".join(random.choice("abc é") for _ in range(random.randint(0, 12)))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            p = random.randint(0, len(b))
            b[p : p + random.randint(0, 1)] = random.choice(["", "a", "c"])
        rows.append((a, "".join(b)))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    for k in (1, 2, 3):
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within(chars("a"), chars("b"), k).alias("ok")).collect()
        assert [(r.a, r.b) for r in got if r.ok != (levenshtein(r.a, r.b) <= k)] == []


def test_line_dedup_against_brute_force(spark):
    random.seed(3)
    base = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(33, 60))) for _ in range(12)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(random.randint(0, 5)):
            x = list(random.choice(base))
            for _ in range(random.randint(0, 3)):
                p = random.randint(0, len(x) - 1)
                x[p : p + random.randint(0, 1)] = random.choice(["", "z", "zz"])
            out.append("".join(x))
        rows.append((i, "\n".join(out + ["short"])))
    first = {}
    for i, t in rows:
        for j, ln in enumerate(t.split("\n")):
            first.setdefault(ln, (i, j))
    near = {a for a in first for b in first if first[b] < first[a] and min(len(a), len(b)) >= lines.MIN_CHARS and levenshtein(a, b) <= lines.EDITS}
    assert len(near) > 5
    want = {i: "\n".join(ln for j, ln in enumerate(t.split("\n")) if not (ln in near or first[ln] != (i, j))) for i, t in rows}
    got = lines.deduped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_pipeline_drops_repeats_of_short_lines(spark):
    import corpus_pipeline as p

    rows = [(1, "Menu\n\nfirst text of the page", 1), (2, "Menu\n\nMena\n  \nsecond", 1), (3, "Menu", 1), (4, "\n  \n", 1)]
    got = p.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: (rows[0][1], 28), 2: ("\nMena\n  \nsecond", 15), 4: (rows[3][1], 4)}


def test_near_lines_of_rows_that_share_an_id(spark):
    a, b = "the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs today"
    rows = [(None, f"x\n{a}"), (None, "only one line"), (None, f"x\n{'0' * 40}"), (3, f"y\n{b}"), (3, f"y\n{'1' * 40}"), (5, f"{a}!\n{b}!\nz")]
    got = lines.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.text, r.n_near) for r in got if r.doc_id == 5] == [("z", 2)]
    assert sorted(r.text for r in got if r.doc_id != 5) == sorted(t for i, t in rows if i != 5)


def test_line_dedup_of_odd_rows(spark, odd, none):
    got = lines.deduped(odd).collect()
    assert len(got) == odd.count() and all((r._k, r.h, r.rank, r.lang) == ("x", 1, 2, None) for r in got)
    again = lines.deduped(odd.select("doc_id", "text", F.lit(9).alias("n_lines"), F.lit("a").alias("drops"), F.lit("b").alias("_row"), F.lit("c").alias("a.b")))
    assert again.columns[2:] == ["drops", "_row", "a.b", "n_lines", "n_dropped", "n_near", "emptied"]
    assert {(r.drops, r["_row"], r["a.b"]) for r in again.collect()} == {("a", "b", "c")}
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].text is None and by[2].text == "" and by[5].text and by[6].text == "" and by[6].emptied
    assert lines.deduped(none).count() == 0


def test_neighbours(spark):
    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = e.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in neighbours.nearest(e, neighbours.divisible(e, 20)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        mine = got[ids[q]]
        assert len(mine) == 20 and all(abs(v - float(x[np.flatnonzero(ids == i)[0]] @ x[q])) < 1e-12 for i, v in mine)
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        recall.append(len(best & {i for i, _ in mine}) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 9.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, []), (40, [2.0, 0.0]), (40, [2.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(e, neighbours.divisible(e, 20), 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {0: [(40, 2.0), (1, 1.0), (2, 1.0)], 40: [(0, 2.0), (1, 2.0), (2, 2.0)]}
    assert neighbours.nearest(e.limit(0), e.limit(0)).count() == 0


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    out = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_top_line_is_sought_in_whole_texts():
    text = "\n".join([f"line {i}" for i in range(60)] + ["repeated"] * 40).encode()
    got = quality.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert got[0, quality.STATS.index("top_line")] == 0.4


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 1.0, 0.5, 2.0]), np.ones(4)).tolist() == [0.0, 0.75, 0.75, 2.0]


def test_classifiers_on_odd_rows(spark, odd, none, labels):
    for f in (quality.score_quality, toxicity.toxicity):
        assert f(odd, labels).count() == odd.count()
        assert all(0 <= r.score <= 1 for r in f(odd, labels.limit(0)).collect())
        assert f(none, labels).count() == 0


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.8


def test_language_model_base(spark, docs, texts):
    got = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    tokens = {i: re.findall(WORD, lower(t)) + ["\n"] for i, t in texts.items()}
    count = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert abs(base - r.base_score) < 1e-6 and math.isfinite(r.score) and r.score < 0


def small_layer(vocab=50, seed=0):
    rng = np.random.default_rng(seed)
    ids, size = rng.integers(0, vocab - 1, 600), np.full(6, 100)
    x, y, on, _ = language_model.windows(ids, size, vocab - 1)
    return language_model.trained(language_model.initial(vocab, np.ones(vocab), rng), x, y, on, 6, 0.05, 1), rng


def test_language_model_scores_each_id_once_and_only_looks_back():
    vocab = 50
    layer, rng = small_layer(vocab)
    of = lambda ids, size: layer.log10(*language_model.windows(ids, np.array(size), vocab - 1)[:3])
    ids = rng.integers(0, vocab - 1, 300)
    lp = of(ids, [100, 0, 200])
    assert len(lp) == 303
    other = ids.copy()
    other[60:100] = rng.integers(0, vocab - 1, 40)
    assert np.allclose(of(other, [100, 0, 200])[:60], lp[:60], atol=1e-6)
    # what follows two ids is a distribution over the vocabulary
    total = sum(10 ** of(np.array([3, 4, x]), [3])[2] for x in range(vocab - 1)) + 10 ** of(np.array([3, 4]), [2])[2]
    assert abs(total - 1) < 1e-3


def test_language_model_layer_against_plain_attention():
    """The batched, windowed layer against one position at a time."""
    vocab, back, step = 50, language_model.BACK, language_model.WINDOW - language_model.BACK
    layer, rng = small_layer(vocab, 4)
    ids = rng.integers(0, vocab - 1, 90)
    got = layer.log10(*language_model.windows(ids, np.array([90]), vocab - 1)[:3])
    p, seq, y = {k: v.astype(float) for k, v in layer.p.items()}, np.r_[vocab - 1, ids], np.r_[ids, vocab - 1]
    for t in range(91):
        first = max(0, -(-(t + 1 - language_model.WINDOW) // step)) * step
        x = p["e"][seq[first : t + 1]] + p["pos"][: t + 1 - first]
        s = np.exp((x[-1] @ p["wq"]) @ (x @ p["wk"]).T / np.sqrt(language_model.WIDTH))
        h = np.maximum(s / s.sum() @ (x @ p["wv"]) + x[-1] @ p["wr"], 0)
        z = np.exp(h @ p["o"] + p["b"])
        assert t - first < language_model.WINDOW and (t - first >= back or first == 0)
        assert abs(got[t] - math.log10(z / z.sum() @ layer.table[y[t]])) < 1e-4


def test_language_model_inside_words():
    rng = np.random.default_rng(2)
    size = np.array([1, 3, 7, 40, 2])
    ids = rng.integers(0, 49, size.sum())
    begin = np.cumsum(size) - size
    met = collections.Counter()
    for source, target, scored, own in language_model.inside_windows(ids, size, 49):
        for x, y, on, k in zip(source, target, scored, own, strict=True):
            met.update((int(k), int(a), int(b)) for a, b in zip(x[on], y[on], strict=True))
    want = collections.Counter()
    for k, (i, n) in enumerate(zip(begin, size, strict=True)):
        w = [*ids[i : i + n].tolist(), 49]
        want.update((k, a, b) for a, b in zip(w, w[1:]))
    assert met == want


def test_language_model_gradients():
    layer, rng = small_layer(20, 3)
    layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    x, y, on = rng.integers(0, 20, (2, 8)), rng.integers(0, 20, (2, 8)), np.ones((2, 8), bool)
    loss = lambda: -layer.log10(x, y, on).mean() * np.log(10)
    grads, _ = language_model._gradients(layer, x, y, on)
    e = np.zeros_like(layer.p["e"])
    np.add.at(e, x.ravel(), grads["e"].reshape(-1, e.shape[1]))
    grads["e"] = e
    for name in ("wq", "wv", "o", "e", "pos"):
        i = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        at, seen = layer.p[name][i], []
        for step in (1e-2, -1e-2):
            layer.p[name][i], layer._inputs = at + step, None
            seen.append(loss())
        layer.p[name][i] = at
        assert abs((seen[0] - seen[1]) / 2e-2 - grads[name][i]) < 0.05 * abs(grads[name][i]) + 1e-4


def test_language_model_layers_learn_from_every_training_text(spark, docs, texts, monkeypatch):
    path = language_model.default_path()
    vocab = language_model.vocabulary(path)
    want = np.zeros(vocab)
    for t in texts.values():
        for w in re.findall(WORD, lower(t)):
            want[language_model.subwords([w.encode()], path)[0][0]] += 1
    want[-1] = len(texts)
    train = docs.select("text", F.xxhash64("doc_id", "text").alias("lot"))
    for size in (2_000_000, 10_000):  # one part, and several in two rounds
        monkeypatch.setattr(language_model, "PART_WORDS", size)
        common = language_model.fitted(train, path, int(want.sum())).between.table[:, -1]
        assert np.allclose(common * (want + language_model.SMOOTH).sum(), want + language_model.SMOOTH, rtol=1e-3, atol=0.02)


def test_language_model_of_odd_rows(spark, odd, none):
    got = language_model.score_documents(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert language_model.score_documents(none).count() == 0


def test_language_model_memories_hold_all_training_texts(spark, docs, texts, monkeypatch):
    """Word and chunk counts against brute force, in small blocks too."""
    monkeypatch.setattr(language_model, "BLOCK", 5_000)
    monkeypatch.setattr(language_model, "FLUSH", 3_000)
    rows = docs.select("text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held")).repartition(3)
    got = {(r.k, r.h % 2**64): r.c for r in language_model.memory_counts(rows).collect()}
    want, train = collections.Counter(), [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    for t in train:
        raw = t.encode()
        h = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[3]
        want.update((0, int(x)) for x in h)
        part = []
        for k, x in enumerate(h):
            part.append(int(x))
            if int(mix64(np.array([x]))[0]) % language_model.CHUNK == 0 or k == len(h) - 1:
                total = sum(int(v) for v in mix64(np.array(part, np.uint64) ^ (np.arange(1, len(part) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) % 2**64
                want[(1, int(mix64(np.array([(2 * total + (k == len(h) - 1)) % 2**64], np.uint64))[0]))] += 1
                part = []
        if not len(h):
            want[(1, int(mix64(np.ones(1, np.uint64))[0]))] += 1
    want[(2, 0)] = len(train)
    assert got == dict(want)


def test_language_model_knows_passages_that_stand_elsewhere(spark):
    random.seed(8)
    text = lambda: " ".join("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(150))
    twice, rows = [text() for _ in range(10)], []
    for k in range(60):
        rows.append((k, twice[k] if k < 10 else twice[k - 10] + " tail" if k < 20 else text()))
    got = {r.doc_id: r.score / r.n_tokens for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [k for k in range(60) if zlib.crc32(str(k).encode()) % 10]
    both = [k for k in range(10) if k in train and k + 10 in train]
    assert max(got[k] for k in range(20, 60)) < min(got[k] for k in both) - 1


def test_language_model_keeps_words_that_come_again(monkeypatch):
    """A worker that knows too many words lets those go that did not come again, and what it says stays the same."""
    path, rng = language_model.default_path(), np.random.default_rng(6)
    vocab = language_model.vocabulary(path)
    layers = [language_model.initial(vocab, np.ones(vocab), rng) for _ in (0, 1)]
    batches = [sorted({*range(50), *range(1000 * b, 1000 * b + 400)}) for b in range(1, 7)]
    said, asked, encode = {}, collections.Counter(), language_model.subwords
    monkeypatch.setattr(language_model, "subwords", lambda texts, path: asked.update(texts) or encode(texts, path))
    for room in (10**6, 1000, 60):
        monkeypatch.setattr(language_model, "KNOWN_WORDS", room)
        asked.clear()
        model = language_model.Model(*layers, path)
        said[room] = [model.lookup(np.array(u, np.uint64), lambda new, u=u: [b"word%d" % u[i] for i in new]) for u in batches]
        assert len(model.known) <= room + 450 and (np.diff(model.known.astype(np.int64)) > 0).all()
        if room >= 1000:
            assert set(asked.values()) == {1}
    for room in (1000, 60):
        for (first, rest), (first2, rest2) in zip(said[10**6], said[room], strict=True):
            assert (first == first2).all() and np.allclose(rest, rest2, atol=1e-4)


def brute_components(texts, num=80, den=100):
    sets = {}
    for i, t in texts.items():
        w = re.findall(WORD, lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for a, b in {(a, b) for v in inverted.values() for a in v for b in v if a < b}:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_shingle_join_on_documents(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_shingle_join_on_edited_copies(spark, monkeypatch):
    """A group of edited copies around one text, cut into several blocks."""
    monkeypatch.setattr(shingles, "BLOCK", 7)
    random.seed(5)
    vocab = [f"v{i}" for i in range(400)]
    base = [random.choice(vocab) for _ in range(120)]
    texts = {0: " ".join(base)}
    for i in range(1, 90):
        w = list(base)
        for _ in range(random.randint(0, 7)):
            w[random.randrange(len(w))] = random.choice(vocab)
        texts[i] = " ".join(w)
    texts[90], texts[91], texts[92] = "a b c", "A B c", ""
    got = shingles.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert 2 < len({c for _, c in want.values()}) < 91


def test_shingle_join_of_odd_rows(spark, odd, none):
    got = shingles.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[6].component_id == 5 and by[1].n_shingles == by[3].n_shingles == 0
    assert by[None].component_id is None
    one = shingles.without_near_duplicates(odd.where("doc_id in (5, 6) or doc_id is null").unionByName(odd.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))))
    assert {r.doc_id for r in one.collect()} == {None}
    assert shingles.near_duplicates(none).count() == 0


def test_components(spark):
    random.seed(6)
    e = [(i, i + 1) for i in range(60)] + [(100 + random.randrange(40), 100 + random.randrange(40)) for _ in range(25)]
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for p in e if p[0] != p[1] for x in p}
    got = components.components(spark.createDataFrame(e, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == want


def test_pii(spark, docs, odd, none):
    find = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\d+\.\d+\.\d+\.\d+|\+\d+ \(\d+\) \d+-\d+|\b\d{16}\b|\b[0-9a-f]{40}\b")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pii.anonymised(docs).collect()}
    assert set(before) == set(after)
    pairs = set()
    for i, t in before.items():
        a, b = find.findall(t), find.findall(after[i])
        assert len(a) == len(b)
        pairs |= set(zip(a, b, strict=True))
        if not a:
            assert after[i] == t
    assert len(pairs) > 5 and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert not {a for a, _ in pairs} & {b for _, b in pairs}
    made = spark.createDataFrame([(1, "Mrs. Anna Schmidt, A.Bc@Ex.org a.bc@ex.org 4111 1111 1111 1111 4111111111111111 SSN 123-45-6789", "k")], "doc_id long, text string, entity string")
    out = pii.anonymised(made).first()
    assert out.n_entities == 6 and out.entity == "k"
    mails = re.findall(r"\S+@\S+", out.text)
    assert mails[0].lower() == mails[1] and mails[0] != mails[1]
    cards = re.search(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16})", out.text)
    assert cards[1].replace(" ", "") == cards[2]
    assert sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(cards[2]))) % 10 == 0
    assert re.match(rf"Mrs\. (?:{'|'.join(pii.GIVEN['LF'])}) ", out.text)
    assert pii.anonymised(odd).count() == odd.count() and pii.anonymised(none).count() == 0


def test_pii_coreference_formats_and_columns(spark):
    """Later mentions of a name, shared last words, prefixes and check digits, and columns of any name."""
    iban = "GB82 WEST 1234 5698 7654 32"
    text = f"Mr. John Smith met Frau Smith. Later Smith wrote, and John Smith (not Smithson) paid {iban}; key sk-abcdefghijkl1234 and ghp_ABCDEFGHIJKL5678"
    rows = [(1, text, 7, 8, 9), (1, "Herr Smith", 7, 8, 9), (None, "no one", 7, 8, 9), (None, "mail x@y.zz", 7, 8, 9), (None, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k int, _m int, n_entities int")
    got = pii.anonymised(docs).collect()
    assert len(got) == 5 and all(r._k == 7 and r._m == 8 for r in got) and list(got[0].asDict()) == ["doc_id", "text", "_k", "_m", "n_entities"]
    out = next(r for r in got if r.text and r.text.startswith("Mr."))
    full = re.match(r"Mr\. (\w+ \w+) met Frau (\w+)\. Later (\w+) wrote, and (\w+ \w+) \(not Smithson\)", out.text)
    assert full and full[1] == full[4] and full[2] == full[3] == full[1].split()[1] and "Smith" not in (full[1], full[2]) and out.n_entities == 7
    assert next(r.text for r in got if r.text and r.text.startswith("Herr")) == f"Herr {full[2]}"
    made = re.search(r"paid ([A-Z0-9 ]+);", out.text)[1]
    flat = made.replace(" ", "")
    assert [len(x) for x in made.split()] == [len(x) for x in iban.split()] and made != iban and flat[:2] == "GB" and flat[4:8].isalpha()
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert re.search(r"key sk-[a-z]{12}\d{4} and ghp_[A-Z]{12}\d{4}$", out.text) and "abcdefghijkl" not in out.text


def test_pii_draws_end_where_a_kind_is_exhausted(spark):
    """More first names to one last word than made-up first names, and more addresses than their form has: all distinct."""
    docs = spark.createDataFrame([(i, f"Mr. {chr(65 + i)}da Smith wrote {chr(97 + i)}@b.de") for i in range(26)] + [(100, " ".join(f"{a}@{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrst"))], "doc_id long, text string")
    texts = [r.text for r in pii.anonymised(docs).orderBy("doc_id").collect()]
    names = {re.match(r"Mr\. (\w+ \w+) wrote", t)[1] for t in texts[:26]}
    assert len(names) == 26 and len({n.split()[1] for n in names}) == 1
    mails = [m for t in texts for m in re.findall(r"\S+@\S+", t)]
    real = {f"{a}@{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrst"}
    assert len(set(mails)) == len(real) and not set(mails) & real


def test_mixing(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    sources = {r.doc_id: r.source for r in docs.collect()}
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r.size == len(re.findall(WORD, texts[r.doc_id])) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        s = sources[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    total, names = sum(size.values()), sorted(size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, open_, left = {}, set(names), float(total)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    largest = max(r.size for r in rows)
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * total and abs(taken[s] - want[s]) <= largest
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    copies = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(copies[r.doc_id] == r.copies for r in rows if r.size)


def test_mixing_caps_and_odd_rows(spark, odd, none):
    rows = [(i, "w " * 10, "a") for i in range(5)] + [(i, "w " * 10, "b") for i in range(5, 300)] + [(i, "w " * 10, None) for i in range(300, 303)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.source_size: r.target for r in got}
    assert by[30] == 90.0 and by[50] == 150.0 and abs(sum(by.values()) - 3030) < 1e-6
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    named = odd.where("doc_id < 4").select("doc_id", "text", "source", F.lit("a").alias("s"), F.lit("b").alias("below"), F.lit("c").alias("row"), F.lit("d").alias("a.b"))
    got = mixing.mixed_documents(named)
    assert got.columns == named.columns and {(r.s, r.below, r.row, r["a.b"]) for r in got.collect()} == {("a", "b", "c", "d")} and got.count() == 3


def test_bpe_equals_the_library(spark, docs, texts, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    random.seed(7)
    more = ["".join(random.choice("aab bA'sre ééΣİ \x1c\x1f\t\n1２<|中😀.,") for _ in range(50)) for _ in range(300)]
    rows = list(texts.values()) + more + ["<|startoftext|>hi<|endoftext|>x", "aaaa aaaaa", "", "ΑΣ"]
    for t, (ids, text) in zip(rows, bpe.coder(bpe.default_path()).encode_batch(rows), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and text == lib.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_documents(odd).collect()}
    assert got[1].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    want = np.array(lib.encode(texts[3], add_special_tokens=False).ids, "<u4").tobytes()
    assert {r.doc_id: r for r in bpe.encode_documents(docs).collect()}[3].ids_sha256 == hashlib.sha256(want).hexdigest()


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    now, names = docs, docs.columns
    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "n-gram jaccard", "mixing", "bpe"]
    before = {r.doc_id for r in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, DIR)
        assert now.columns == names
        assert {r.doc_id for r in now.select("doc_id").collect()} <= before
    out = p.run(spark, DIR)
    assert out.count() > 0.6 * len(before)


def test_mix64_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix64(x))) == len(x)


def test_near_duplicates_go_by_row(spark):
    """Rows that share an id stay or go with their own texts: no component loses its last row."""
    long = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "ABC"}
    near = long["A"] + " more"
    rows = [(3, long["B"]), (5, long["A"]), (5, long["B"]), (7, long["A"]), (8, near), (9, long["C"]), (9, "short"), (9, None), (None, long["C"]), (5, long["A"])]
    docs = spark.createDataFrame([(i, t, None, None, None, "k", 1, 2) for i, t in rows], DOC)
    got = shingles.without_near_duplicates(docs).collect()
    texts = collections.Counter((r.doc_id, r.text) for r in got)
    assert texts == collections.Counter([(3, long["B"]), (5, long["A"]), (5, long["A"]), (None, long["C"]), (9, "short"), (9, None)])
    assert got[0]._k == "k" and set(got[0].asDict()) == set(docs.columns)


def test_a_part_of_the_language_model_is_cut_in_blocks():
    import tracemalloc

    path = language_model.default_path()
    vocab = language_model.vocabulary(path)
    texts = [" ".join(f"w{(i * 7919 + j) % 5000}" for j in range(20_000)).encode() for i in range(30)]
    language_model._part(texts[:1], path, vocab)
    tracemalloc.start()
    counts, _, _ = language_model._part(texts, path, vocab)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[0].sum() == 600_000 + 30
    assert peak < 120 * 600_000  # bytes a word
