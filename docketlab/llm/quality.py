"""Quality classifier: kernel ridge regression by random Fourier features over document statistics, calibrated.

Each text gives a fixed vector of statistics. Cosines of random projections of the standardised vector
approximate a Gaussian kernel. Every partition sums its part of the normal equations over the labelled
training rows; the sums are added by key and solved once. An isotonic fit over bins of the raw scores of
the same rows turns scores into probabilities.

Sizes on the driver: FEATURES squared sums, BINS counts; neither depends on the number of rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDS_LABELS, arrow, blocks, fold, fold_of, modest_batches, stored, utf8, words

FEATURES, BINS, RIDGE, SEED = 256, 512, 0.1, 20
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
STATS = (
    "chars words word_length long_words distinct_words top_word top_pair distinct_pairs lines line_length short_lines distinct_lines"
    " top_line capitals digits marks ends exclamations pipes symbols other brackets non_ascii spaces entropy compressed capital_words stops"
).split()


def _shares(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct share of the keys, and the share of the most frequent one."""
    total = np.bincount(row, minlength=n)
    distinct, top = np.ones(n), np.zeros(n)
    if len(key):
        order = np.lexsort((key, row))
        k, r = key[order], row[order]
        at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        runs = np.diff(np.r_[at, len(k)])
        d = np.bincount(r[at], minlength=n)
        m = np.zeros(n)
        np.maximum.at(m, r[at], runs)
        some = total > 0
        distinct[some], top[some] = d[some] / total[some], m[some] / total[some]
    return distinct, top


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS for each text data[off[i]:off[i+1]]; all finite, also for empty texts."""
    n = len(off) - 1
    start, end, row, h = words(data, off)
    size = (end - start).astype(float)
    per = np.maximum(np.bincount(row, minlength=n), 1)
    out = np.zeros((n, len(STATS)))
    hist = np.stack([np.bincount(data[off[i] : off[i + 1]], minlength=256) for i in range(n)]).astype(float) if n else np.zeros((0, 256))
    chars = np.maximum(hist.sum(1), 1)
    # continuation bytes do not count as characters of their own
    letters = np.maximum(hist[:, 65:91].sum(1) + hist[:, 97:123].sum(1), 1)
    p = hist / chars[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)
    distinct, top = _shares(h, row, n)
    same = row[1:] == row[:-1]
    pair = (h[:-1] * np.uint64(31) + h[1:])[same]
    distinct2, top2 = _shares(pair, row[1:][same], n)
    lines = [bytes(data[off[i] : off[i + 1]]).split(b"\n") for i in range(n)]
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    first = data[start] if len(start) else np.zeros(0, np.uint8)
    cols = {
        "chars": np.log1p(chars),
        "words": np.log1p(per),
        "word_length": np.bincount(row, weights=size, minlength=n) / per,
        "long_words": np.bincount(row, weights=size > 20, minlength=n) / per,
        "distinct_words": distinct,
        "top_word": top,
        "distinct_pairs": distinct2,
        "top_pair": top2,
        "lines": np.log1p([len(x) for x in lines]),
        "line_length": np.log1p(chars / np.array([len(x) for x in lines])) if n else np.zeros(0),
        "short_lines": np.array([sum(len(y) < 30 for y in x) / len(x) for x in lines]),
        "distinct_lines": np.array([len(set(x)) / len(x) for x in lines]),
        "top_line": np.array([max(Counter(x).values()) / len(x) for x in lines]) if n else np.zeros(0),
        "capitals": hist[:, 65:91].sum(1) / letters,
        "digits": hist[:, 48:58].sum(1) / chars,
        "marks": hist[:, [44, 46, 58, 59, 63]].sum(1) / per,
        "ends": np.bincount(row, weights=np.isin(last, [33, 46, 63]), minlength=n) / per,
        "exclamations": hist[:, 33] / per,
        "pipes": hist[:, 124] / per,
        "symbols": hist[:, [35, 36, 37, 38, 42, 64, 94, 126]].sum(1) / per,
        "other": hist[:, [43, 45, 47, 60, 61, 62, 92, 95, 96]].sum(1) / per,
        "brackets": hist[:, [40, 41, 91, 93, 123, 125]].sum(1) / per,
        "non_ascii": hist[:, 128:].sum(1) / chars,
        "spaces": hist[:, [9, 10, 13, 32]].sum(1) / chars,
        "entropy": entropy,
        "compressed": np.array([len(zlib.compress(bytes(data[off[i] : off[i + 1]]), 1)) for i in range(n)]) / chars,
        "capital_words": np.bincount(row, weights=(first >= 65) & (first <= 90), minlength=n) / per,
        "stops": np.bincount(row, weights=size <= 3, minlength=n) / per,
    }
    for k, name in enumerate(STATS):
        out[:, k] = cols[name]
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (its statistics) of every row, from whole texts, stored: the one pass over the texts."""
    schema = "doc_id long, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in blocks(off):
                x = statistics(data, off[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), lists], schema=arrow(schema))

    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "statistics")


@dataclass
class Model:
    """Standardisation, random features, ridge weights, and the calibration's bin edges and values."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1] / 2)
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.c_[np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        # between the middles of bins the calibration runs straight, so ranks within a step survive
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def isotonic(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the non-decreasing fit to bin means."""
    pools: list[list[float]] = []
    for m, w in zip(mean, weight, strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools.pop()
            pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), m) for m, _, n in pools]) if pools else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(-1, len(STATS))


def _summed(rows: DataFrame, part, keys: int) -> dict[int, np.ndarray]:
    """Sums by key of vectors that `part` yields once per partition; at most `keys` keys come back."""
    per_task = rows.mapInArrow(part, "k int, v array<double>")
    names = per_task.select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    got = names.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).collect()
    for r in got:
        out[r["k"]] = np.array([x["v"] for x in r["v"]])
    return out


def _emit(vectors: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(vectors), pa.int32()), pa.array([v.tolist() for v in vectors.values()], pa.list_(pa.float64()))], schema=arrow("k int, v array<double>"))


def train(stats: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """Fitted on all labelled rows outside the held-out fold. Without any, scores are 1 for every text."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).where(fold(F.col("doc_id"), FOLDS_LABELS) != 0).groupBy("doc_id").agg(F.max(target).cast("double").alias("y"))
    rows = stored(stats.join(y, "doc_id").select("x", "y"), "training")
    d = len(STATS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(2 * d + 2)
        for b in batches:
            x, t = _matrix(b.column(0)), b.column(1).to_numpy()
            s += np.r_[x.sum(0), (x**2).sum(0), len(x), t.sum()]
        yield _emit({0: s})

    s = _summed(rows, moments, 1).get(0, np.zeros(2 * d + 2))
    n = s[-2]
    if not n:
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0]), np.array([1.0]))
    mean = s[:d] / n
    model = Model(mean, np.sqrt(np.maximum(s[d : 2 * d] / n - mean**2, 1e-12)), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = model.features(_matrix(b.column(0)))
            g += z.T @ np.c_[z, b.column(1).to_numpy()]
        yield _emit(dict(enumerate(g)))

    sums = _summed(rows, normal, FEATURES + 1)
    g = np.stack([sums[k] for k in range(FEATURES + 1)])
    model.weights = np.linalg.solve(g[:, :-1] + RIDGE * n * np.diag(np.r_[np.full(FEATURES, 1 / FEATURES), 1e-6]), g[:, -1])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, BINS))
        for b in batches:
            at = np.clip(((model.raw(_matrix(b.column(0))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            c += np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=b.column(1).to_numpy(), minlength=BINS)])
        yield _emit(dict(enumerate(c)))

    c = _summed(rows, counts, 2)
    some = np.flatnonzero(c[0] > 0)
    values = isotonic(c[1][some] / c[0][some], c[0][some])
    model.edges, model.values = (some + 0.5) / BINS * 2 - 0.5, values
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts are scored by the statistics of an empty text. A null id counts as '' for held_out
    and is never trained on. Repeated rows score alike; a row that repeats an id is trained on as often as it
    occurs, labels given twice count as the larger. Columns other than doc_id and text are not read.
    """
    modest_batches(docs.sparkSession)
    stats = document_statistics(docs)
    model = train(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column(1)))
            held = [fold_of("" if i is None else i, FOLDS_LABELS) == 0 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=arrow(SCHEMA))

    return stats.mapInArrow(run, SCHEMA)
