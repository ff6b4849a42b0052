"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters vote "toxic", "clean" or abstain. The label model is fitted by EM for a given class balance:
for each voter, its vote rates in both classes; voters that still agree beyond what the class explains
(conditional correlation) are merged into one. Its posteriors train a logistic classifier over the
presence of lexicon words, patterns and common words, which scores every document.

Labels serve only to propose lexicon voters (words far likelier in toxic training rows) and for the class
balance, on a bounded sample of SAMPLE training rows; the voters' accuracies do not come from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDS_LABELS, arrow, blocks, fold, fold_of, modest_batches, utf8, words

#: Labelled training rows that may be read for fitting.
SAMPLE = 4_000
MINED, COMMON = 128, 1024
#: Lengths in bytes of the word beginnings that count as features beside whole words.
PREFIXES = (5, 6, 7)
#: Unlike toxic rows that a proposed lexicon word needs.
SUPPORT = 5
THRESHOLD = 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Lexicon voters: general English, French, German and Spanish insults and threats, by kind.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile fool foolish clown halfwit dimwit idiote idioten dumm dumme blöd imbécile crétin stupide estúpido estúpida tonto tonta",
    "worth": "worthless loser losers pathetic useless failure nobody versager wertlos minable inútil perdedor perdedora fracasado",
    "filth": "trash garbage scum filth vermin dirt disgusting abschaum dreck müll widerlich ordure ordures déchet dégoûtant basura escoria asqueroso asquerosa",
    "hate": "hate despise loathe detest hasse verachte déteste hais odio desprecio",
    "threat": "kill murder destroy töten umbringen tuer mourir matar morir",
    "insult": "jerk bastard creep coward liar freak ugly arsch arschloch feigling connard salaud lâche cabrón cobarde feo fea",
}

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(_LETTERS[raw], np.array([0, len(raw)]))[3][0])


def document_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of each row's words (runs of letters and non-ASCII bytes, A-Z lower-cased) and of the
    words' first PREFIXES bytes, which stand for their stems."""
    _, _, row, h, stems = words(_LETTERS[data[off[0] : off[-1]]], off - off[0], PREFIXES)
    return np.concatenate([row, *(r for r, _ in stems)]), np.concatenate([h, *(s for _, s in stems)])


def pattern_stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row: share of capitals among letters, of exclamation marks, of symbols."""
    out = np.zeros((len(off) - 1, 3))
    for i in range(len(off) - 1):
        c = np.bincount(data[off[i] : off[i + 1]], minlength=256)
        n = max(c.sum(), 1)
        caps, low = c[65:91].sum(), c[97:123].sum()
        out[i] = caps / max(caps + low, 1), c[33] / n, c[[35, 36, 37, 38, 42, 64]].sum() / n
    return out


@dataclass
class Model:
    """Sorted feature word hashes, their weights, pattern weights and bias; `lexicon` marks insult words."""

    hashes: np.ndarray
    weights: np.ndarray
    pattern: np.ndarray
    bias: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, h = document_words(data, off)
        return _logistic(_presence(row, h, len(off) - 1, self.hashes) @ self.weights + _pattern_votes(pattern_stats(data, off)) @ self.pattern + self.bias)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _presence(row: np.ndarray, h: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(hashes)), np.float32)
    if len(hashes) and len(h):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        out[row[hit], at[hit]] = 1
    return out


def _pattern_votes(stats: np.ndarray) -> np.ndarray:
    return (stats > np.array([0.5, 0.02, 0.05])).astype(np.float32)


def _em(votes: np.ndarray, prior: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors and each voter's rates of (clean, abstain, toxic) votes in the toxic and the clean class."""
    kinds = [(votes == v).astype(np.float64) for v in (-1, 0, 1)]
    q = np.clip(0.5 + 0.45 * np.sign(votes.sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        hi = np.stack([(k.T @ q + 0.5) / (q.sum() + 1.5) for k in kinds])
        lo = np.stack([(k.T @ (1 - q) + 0.5) / ((1 - q).sum() + 1.5) for k in kinds])
        ratio = np.log(hi) - np.log(lo)
        # a vote never speaks against its own side, and not voting says nothing
        ratio[2], ratio[0], ratio[1] = np.maximum(ratio[2], 0), np.minimum(ratio[0], 0), 0
        q = _logistic(np.log(prior / (1 - prior)) + sum(k @ r for k, r in zip(kinds, ratio, strict=True)))
    return q, hi, lo


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "toxic" for each row of votes (1 toxic, -1 clean, 0 abstain), the voters' accuracies, and
    the cluster of each voter.

    A first EM takes the voters as independent given the class. Voters whose votes still correlate beyond
    what the class explains are one witness: each such cluster votes once, and a second EM weighs clusters.
    """
    q, hi, lo = _em(votes, prior, rounds)
    left = votes - (q[:, None] * (hi[2] - hi[0]) + (1 - q)[:, None] * (lo[2] - lo[0]))
    sd = np.sqrt((left**2).mean(0)) + 1e-9
    tied = (left.T @ left) / len(votes) / np.outer(sd, sd) > 0.3
    against = (votes < 0).any(0)
    cluster = np.arange(votes.shape[1])
    for _ in range(votes.shape[1]):
        new = np.array([cluster[tied[j] & (against == against[j])].min(initial=cluster[j]) for j in range(len(cluster))])
        if (new == cluster).all():
            break
        cluster = new
    merged = np.stack([np.where((v := votes[:, cluster == c]).max(1) > 0, 1, v.min(1)) for c in np.unique(cluster)], 1)
    q, _, _ = _em(merged, prior, rounds)
    right = (votes > 0).T @ q + (votes < 0).T @ (1 - q)
    return q, (right + 0.5) / ((votes != 0).sum(0) + 1), cluster


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps for soft labels y with an L2 penalty; returns weights and bias."""
    a = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(a.shape[1])
    pen = np.r_[np.full(x.shape[1], l2), 1e-6]
    for _ in range(rounds):
        p = _logistic(a @ w)
        g = a.T @ (p - y) + pen * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _spread(sets: list[np.ndarray], docs: np.ndarray) -> bool:
    """Whether at least SUPPORT of the documents are no copies of one another (word sets under 0.4 alike)."""
    picked: list[np.ndarray] = []
    for d in docs:
        own = sets[d]
        if all(2 * np.isin(own, p, assume_unique=True).sum() < 0.57 * (len(own) + len(p)) for p in picked):
            picked.append(own)
            if len(picked) >= SUPPORT:
                return True
    return False


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.isin(a, b, assume_unique=True).sum()
    return both > 0.9 * (len(a) + len(b) - both)


def fit(row: np.ndarray, h: np.ndarray, stats: np.ndarray, toxic: np.ndarray) -> Model:
    """The model from a sample: rows and hashes of distinct words, pattern statistics and 0/1 labels."""
    n = len(toxic)
    fixed = {name: np.array(sorted({word_hash(w) for w in text.split()}), np.uint64) for name, text in LEXICONS.items()}
    if not n:
        hashes = np.unique(np.concatenate(list(fixed.values())))
        return Model(hashes, np.full(len(hashes), 4.0), np.zeros(3), -3.0)
    # rare words go first, by a table of counts over hash slots, so that the exact counts stay small
    slot = (h & np.uint64((1 << 21) - 1)).astype(np.int32)
    often = np.bincount(slot, minlength=1 << 21)[slot] >= SUPPORT
    row, h = row[often], h[often]
    del slot, often
    vocab, inverse = np.unique(h, return_inverse=True)
    df = np.bincount(inverse, minlength=len(vocab))
    pos = np.bincount(inverse, weights=toxic[row], minlength=len(vocab))
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((df - pos + 0.5) / (n0 + 1))
    z = (pos - df * n1 / n) / np.sqrt(np.maximum(df * n1 / n, 1e-9))
    mined = np.flatnonzero((odds > 3.2) & (z > 6) & (pos >= SUPPORT))
    mined = mined[np.argsort(-z[mined], kind="stable")][: 8 * MINED]
    sets = np.split(h, np.cumsum(np.bincount(row, minlength=n))[:-1])
    by_word = {int(w): row[inverse == w] for w in mined}
    chosen: list[int] = []
    for w in by_word:  # a word and its stem, found in the same documents, make one voter
        own = by_word[w]
        if len(chosen) < MINED and not any(_same(own, by_word[c]) for c in chosen) and _spread(sets, own[toxic[own] > 0]):
            chosen.append(w)
    mined = np.sort(vocab[chosen])
    common = np.argsort(-df, kind="stable")[:COMMON]
    common = vocab[common[df[common] >= max(5, n // 200)]]
    # voters: each fixed lexicon, each mined word, two or more different insults, patterns, nothing found
    each = _presence(row, h, n, mined)
    groups = [_presence(row, h, n, v).any(1) for v in fixed.values()]
    found = each.sum(1) + np.sum(groups, 0)
    votes = np.c_[np.stack(groups, 1), each, found >= 2, _pattern_votes(stats)].astype(np.int8)
    votes = np.c_[votes, np.where(found == 0, -1, 0)]
    q, _, _ = label_model(votes.astype(np.float64), float(np.clip(toxic.mean(), 0.01, 0.5)))
    hashes = np.unique(np.concatenate([mined, common, *fixed.values()]))
    x = np.c_[_presence(row, h, n, hashes), _pattern_votes(stats)]
    strong = np.isin(hashes, np.concatenate([mined, *fixed.values()]))
    scale = np.r_[np.where(strong, 12.0, 0.25), np.full(3, 0.25)]  # common words only tip the balance
    w, b = logistic_fit(x * scale, q)
    return Model(hashes, w[:-3] * scale[:-3], w[-3:] * scale[-3:], b)


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, pattern statistics and labels of at most `size` training rows, least hash first."""
    rows = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), FOLDS_LABELS) != 0)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in blocks(off):
                row, h = document_words(data, off[i : j + 1])
                h = h[np.argsort(row, kind="stable")]
                sets = [np.unique(x).tobytes() for x in np.split(h, np.cumsum(np.bincount(row, minlength=j - i))[:-1])]
                st = pattern_stats(data, off[i : j + 1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), b.column(2).slice(i, j - i).cast(pa.int32()), pa.array(sets, pa.binary()), *(pa.array(st[:, k]) for k in range(3))], schema=arrow("doc_id long, toxic int, words binary, a double, b double, c double"))

    # at most `size` rows are broadcast, and at most `size` come back
    joined = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("doc_id", "text", "toxic")
    got = joined.mapInArrow(run, "doc_id long, toxic int, words binary, a double, b double, c double").toArrow().sort_by("doc_id")
    sets = [np.frombuffer(w, np.uint64) for w in got.column("words").to_pylist()]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    stats = np.stack([got.column(c).to_numpy() for c in "abc"], 1) if len(sets) else np.zeros((0, 3))
    return row, np.concatenate(sets) if sets else np.zeros(0, np.uint64), stats, got.column("toxic").to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    modest_batches(docs.sparkSession)
    return fit(*_sample(docs, labels, size))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text; no shuffle.

    Null and empty texts get the score of a text without words. A null id counts as '' for held_out. Repeated
    rows score alike. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            score = np.concatenate([model.score(data, off[i : j + 1]) for i, j in blocks(off)]) if b.num_rows else np.zeros(0)
            held = [fold_of("" if d is None else d, FOLDS_LABELS) == 0 for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=arrow(SCHEMA))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; columns and repeated rows stay as they are."""
    model, schema = train(docs, labels), docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(at))
            keep = np.concatenate([model.score(data, off[i : j + 1]) < THRESHOLD for i, j in blocks(off)]) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
