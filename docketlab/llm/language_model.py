"""LM scoring by a small causal self-attention model over subword ids, trained in numpy.

A word is a run of subword ids whose first one begins with a space. One attention layer reads the first ids of the
words before and predicts the next word's first id or the end of the text; another reads a word's ids so far and
predicts its next id or its end. The output of a layer weighs EXPERTS distributions over the vocabulary, so that it is
a distribution without a softmax over the vocabulary. Texts are read in overlapping windows: each window reads BACK
positions of context again and scores only those after them, so every id is scored once; what follows inside a word
depends on that word alone and is kept for the words a worker has met.

The attention's probability is mixed with two memories of all training texts, which grow with them: the frequency of
frequent words, and that of chunks. A chunk is a run of words up to one whose hash is divisible by CHUNK, or up to the
end of the text: no chunk begins another, so chunk frequencies are a distribution too, and a passage that stands
elsewhere is recognised whatever stands around it. A training text's own occurrence of a chunk is taken off.

The layers are fitted on all training documents, by federated averaging: each task trains on its own part from the same
start, and the results are averaged, in ROUNDS rounds, each over its own share of the documents (over all of them in a
corpus of one part). What the output distributions are made of, responsibilities and counts of ids, is summed over all
parts of all rounds. Parts have about PART_WORDS, so their number grows with the corpus. Words are the same wherever
they stand, so the layer inside words reads each distinct word of a part once, weighed by how often it occurs.

The base score needs each word's count over all training documents. Words with at least 1 / HOT of all tokens (so at
most HOT of them), and chunks likewise, are sent to every task; the others' counts are joined.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDS_LM, arrow, blocks, fold, mix64, modest_batches, stored, utf8, words

WINDOW, BACK = 32, 8
#: Words of up to so many ids, with their end, are read in windows of this size.
WORD_WINDOWS = (4, 8, 16)
WIDTH, HIDDEN, EXPERTS = 8, 16, 10
PART_WORDS, ROUNDS, STEPS, REFRESH, BATCH, SEED = 2_000_000, 2, 120, 240, 96, 5
HOT, CHUNK = 1 << 20, 16
#: Shares of the frequent words' frequencies in a word's probability, and of the chunks' in a chunk's.
WORD_SHARE, CHUNK_SHARE = 0.3, 0.3
SMOOTH, PRIOR = 0.1, 300.0
#: Words a worker keeps what it knows of.
KNOWN_WORDS = 1_500_000
#: Positions scored at once: larger arrays cost more where all cores are busy.
SCORED_AT_ONCE = 2048
FLUSH, BLOCK = 1_000_000, 1 << 20
COUNTS = "k int, h long, c long"
PART = "doc_id long, held boolean, n_tokens long, n_known long, log_sum double, score double, k array<int>, h array<long>, m array<float>"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The rank file's encoder, and which ids begin with a space."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    starts = np.zeros(max(ranks.values()) + 1, bool)
    starts[[i for t, i in ranks.items() if t[:1] == b" "]] = True
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), starts


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary(path: str) -> int:
    """Ids of the vocabulary and one more, the end of a text or of a word."""
    return len(_tokenizer(path)[1]) + 1


def cut(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]


def subwords(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, each read with a space before it, and how many each word has."""
    coder, starts = _tokenizer(path)
    ids = coder.encode_to_numpy((b" " + b" ".join(texts)).decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)
    at = np.flatnonzero(starts[ids]) if len(ids) else np.zeros(0, int)
    if len(at) != len(texts):  # a pattern that joins what we keep apart: one by one
        each = [coder.encode_ordinary(" " + t.decode("utf-8", "replace")) for t in texts]
        return np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64)
    return ids, np.diff(np.r_[at, len(ids)])


@dataclass
class Layer:
    """One attention layer and its output distributions; the last column of the table is the training frequency."""

    p: dict[str, np.ndarray]
    table: np.ndarray  # vocab x (EXPERTS + 1)
    _inputs: tuple | None = field(default=None, repr=False)
    soft: np.ndarray | None = field(default=None, repr=False)  # responsibilities met in training, vocab x EXPERTS

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Query, residual, key and value of each id, and of each position, side by side: what is read is their sum."""
        if self._inputs is None:
            w = np.concatenate([self.p["wq"] / np.sqrt(WIDTH), self.p["wr"], self.p["wk"], self.p["wv"]], 1)
            self._inputs = (self.p["e"] @ w).astype(np.float32), (self.p["pos"] @ w).astype(np.float32)
        return self._inputs

    def log10(self, source: np.ndarray, target: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """log10 probability of the scored targets, in order. Positions before a window's first scored one are only
        looked back at."""
        of_id, of_place = self.inputs()
        held, begin = of_id[:, WIDTH + HIDDEN :], scored.argmax(1)
        out = np.zeros(source.shape)
        width = source.shape[1]
        mask, per = np.tri(width, dtype=np.float32), max(1, SCORED_AT_ONCE // width)
        for low in np.unique(begin):
            rows = np.flatnonzero(begin == low)
            for i in range(0, len(rows), per):
                take = rows[i : i + per]
                on = np.flatnonzero(scored[take, low:])
                x, past = of_id[source[take, low:], : WIDTH + HIDDEN], held[source[take]]
                x += of_place[low:width, : WIDTH + HIDDEN]
                past += of_place[:width, WIDTH + HIDDEN :]
                s = x[..., :WIDTH] @ past[..., :WIDTH].transpose(0, 2, 1)
                np.clip(s, -60, 60, out=s)
                np.exp(s, out=s)
                s *= mask[low:]
                h = (s @ past[..., WIDTH:]).reshape(-1, HIDDEN)
                h /= s.reshape(-1, width) @ np.ones((width, 1), np.float32)
                h += x[..., WIDTH:].reshape(-1, HIDDEN)
                h = h.take(on, 0)
                np.maximum(h, 0, out=h)
                z = self.p["o"].T @ h.T
                z += self.p["b"][:, None]
                np.minimum(z, 60, out=z)
                np.exp(z, out=z)
                p = (z * self.table.take(target[take, low:].ravel()[on], 0).T).sum(0) / z.sum(0)
                mine = np.zeros((len(take), width - low))
                mine.ravel()[on] = np.log10(np.maximum(p, 1e-30))
                out[take, low:] = mine
        return out[scored]


@dataclass
class Model:
    between: Layer
    inside: Layer
    path: str
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    met: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # which were asked for again since the last were let go

    def lookup(self, u: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """First id, and log10 probability of what follows it, of words by their sorted hashes u; text_of gives texts."""
        at = np.searchsorted(self.known, u)
        new = self.known[np.minimum(at, len(self.known) - 1)] != u if len(self.known) else np.ones(len(u), bool)
        self.met[at[~new]] = True
        if new.any():
            if len(self.known) > KNOWN_WORDS:  # words that did not come again go, or all but this batch's, if too many did
                keep = self.met if self.met.sum() <= KNOWN_WORDS // 2 else np.isin(self.known, u)
                self.known, self.first, self.rest = self.known[keep], self.first[keep], self.rest[keep]
                self.met = np.zeros(len(self.known), bool)
                at = np.searchsorted(self.known, u)
            ids, size = subwords(text_of(np.flatnonzero(new)), self.path)
            begin = np.cumsum(size) - size
            rest = np.zeros(len(size))
            for source, target, scored, own in inside_windows(ids, size, len(self.inside.table) - 1):
                rest += np.bincount(np.repeat(own, scored.sum(1)), weights=self.inside.log10(source, target, scored), minlength=len(size))
            place = at[new] + np.arange(len(size))
            old = np.ones(len(self.known) + len(place), bool)
            old[place] = False
            for name, x in {"known": u[new], "first": ids[begin], "rest": rest, "met": False}.items():
                whole = np.empty(len(old), getattr(self, name).dtype)
                whole[place], whole[old] = x, getattr(self, name)
                setattr(self, name, whole)
            at = np.searchsorted(self.known, u)
        return self.first[at], self.rest[at]


def windows(ids: np.ndarray, size: np.ndarray, end: int, width: int = WINDOW, back: int = BACK) -> tuple[np.ndarray, ...]:
    """Windows over each text's ids and its end: inputs (the id before each target; `end` also stands before the
    first), targets, whether a position is scored here, and each window's text."""
    n = size + 1
    step = width - back
    count = np.maximum(1, -(-(n - back) // step))
    text = np.repeat(np.arange(len(size)), count)
    first = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
    # one array in which every text has an end on both sides
    full = np.full(int((size + 1).sum()) + width + 1, end, np.int32)
    full[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size) + 1] = ids
    at = (np.cumsum(n) - n)[text] + first
    both = np.lib.stride_tricks.sliding_window_view(full, width + 1)[at]
    pos = np.arange(width)
    scored = (pos < (n[text] - first)[:, None]) & ((pos >= back) | (first == 0)[:, None])
    return both[:, :-1], both[:, 1:], scored, text


def inside_windows(ids: np.ndarray, size: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows over the ids of words, by length; a word's first id is given, not scored."""
    low = 0
    for width in (*WORD_WINDOWS, WINDOW):
        pick = (size >= low) & ((size < width) | (width == WINDOW))
        low = width
        if pick.any():
            source, target, scored, own = windows(ids[np.repeat(pick, size)], size[pick], end, width, BACK if width == WINDOW else 0)
            scored[np.r_[True, own[1:] != own[:-1]], 0] = False
            yield source, target, scored, np.flatnonzero(pick)[own]


def chunks(h: np.ndarray, row: np.ndarray, n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk of each word, then each chunk's text and hash; ends: whether a word ends its chunk. Texts without
    words have one chunk, which is their end."""
    size = np.bincount(row, minlength=n)
    stop = ends.copy()
    final = np.cumsum(size)[size > 0] - 1
    stop[final] = True
    index = np.cumsum(stop) - stop
    begin = np.flatnonzero(np.r_[True, stop[:-1]]) if len(h) else np.zeros(0, int)
    place = np.arange(len(h)) - begin[index] if len(h) else np.zeros(0, int)
    key = np.add.reduceat(mix64(h ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), begin) if len(h) else np.zeros(0, np.uint64)
    last = np.zeros(len(begin), np.uint64)
    last[index[final]] = 1
    empty = np.flatnonzero(size == 0)
    return index, np.r_[row[begin], empty], mix64(np.r_[key * np.uint64(2) + last, np.ones(len(empty), np.uint64)])


def _lean(vocab: int) -> np.ndarray:
    """Experts begin as shares of the vocabulary that a hash deals out, so that training can tell them apart."""
    return 1 + 2.0 * (mix64(np.arange(vocab, dtype=np.uint64) + np.uint64(vocab))[:, None] % np.uint64(EXPERTS) == np.arange(EXPERTS, dtype=np.uint64))


def initial(vocab: int, counts: np.ndarray, rng: np.random.Generator) -> Layer:
    common = (counts + SMOOTH) / (counts + SMOOTH).sum()
    p = {
        "e": rng.normal(0, 0.3, (vocab, WIDTH)),
        "pos": rng.normal(0, 0.05, (WINDOW, WIDTH)),
        **{"w" + c: rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN if c in "vr" else WIDTH)) for c in "qkvr"},
        "o": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, EXPERTS + 1)),
        "b": np.zeros(EXPERTS + 1),
    }
    table = common[:, None] * _lean(vocab)
    return Layer({k: v.astype(np.float32) for k, v in p.items()}, np.c_[table / table.sum(0), common].astype(np.float32))


def _gradients(layer: Layer, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean negative log-likelihood, and the responsibilities of the experts (in rows) at each position
    that counts, in order. on: which positions count, or how much.

    Sums over short rows are products with ones, all weights of an input are one matrix, and experts are rows: many small
    operations cost more than the arithmetic. Attention stays unscaled; what it is multiplied with is divided by its
    sums instead, and the sum over a row of its gradient is that of the row's result."""
    p, n, (many, t) = layer.p, max(float(on.sum()), 1.0), x.shape
    scale = np.float32(1 / np.sqrt(WIDTH))
    w = np.concatenate([p["wq"] * scale, p["wk"], p["wv"], p["wr"]], 1)
    inp = p["e"].take(x, 0)
    inp += p["pos"][:t]
    inp = inp.reshape(-1, WIDTH)
    a = (inp @ w).reshape(many, t, -1)
    q, k, v, r = a[..., :WIDTH], a[..., WIDTH : 2 * WIDTH], a[..., 2 * WIDTH : 2 * WIDTH + HIDDEN], a[..., 2 * WIDTH + HIDDEN :]
    s = q @ k.transpose(0, 2, 1)
    np.clip(s, -60, 60, out=s)
    np.exp(s, out=s)
    s *= np.tri(t, dtype=np.float32)
    sums = s.reshape(-1, t) @ np.ones((t, 1), np.float32)
    past = (s @ v).reshape(-1, HIDDEN)
    past /= sums
    h = past + r.reshape(-1, HIDDEN)
    pick = np.flatnonzero(on)
    h = h.take(pick, 0)
    np.maximum(h, 0, out=h)
    z = p["o"].T @ h.T
    z += p["b"][:, None]
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    ones = np.ones(EXPERTS + 1, np.float32)
    z /= ones @ z
    resp = z * layer.table.take(y.ravel()[pick], 0).T
    resp /= np.maximum(ones @ resp, 1e-30)
    dz = z - resp
    dz *= (on.ravel()[pick] / np.float32(n)).astype(np.float32)
    g = {"o": h.T @ dz.T, "b": dz.sum(1)}
    da = np.empty_like(a)
    dh = np.zeros((many * t, HIDDEN), np.float32)
    dh[pick] = (dz.T @ p["o"].T) * (h > 0)
    da[..., 2 * WIDTH + HIDDEN :] = dh.reshape(many, t, HIDDEN)
    dh /= sums
    past *= dh
    whole = past @ np.ones((HIDDEN, 1), np.float32)
    dh = dh.reshape(many, t, HIDDEN)
    ds = dh @ v.transpose(0, 2, 1)
    ds -= whole.reshape(many, t, 1)
    ds *= s
    np.matmul(ds, k, out=da[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=da[..., WIDTH : 2 * WIDTH])
    np.matmul(s.transpose(0, 2, 1), dh, out=da[..., 2 * WIDTH : 2 * WIDTH + HIDDEN])
    da = da.reshape(many * t, -1)
    gw = inp.T @ da
    g |= {"wq": gw[:, :WIDTH] * scale, "wk": gw[:, WIDTH : 2 * WIDTH], "wv": gw[:, 2 * WIDTH : 2 * WIDTH + HIDDEN], "wr": gw[:, 2 * WIDTH + HIDDEN :]}
    dinp = da @ w.T
    g["pos"] = np.zeros_like(p["pos"])
    g["pos"][:t] = dinp.reshape(many, -1).sum(0).reshape(t, WIDTH)
    g["e"] = dinp
    return g, resp


def batch_of(x: np.ndarray) -> int:
    """Windows a step reads: BATCH of the longest, more of shorter ones."""
    return BATCH * max(1, WINDOW // x.shape[1])


def trained(layer: Layer, x: np.ndarray, y: np.ndarray, on: np.ndarray, steps: int, rate: float, seed: int) -> Layer:
    """The layer after so many steps over windows x, y: adaptive gradient steps for the attention, and after each pass
    (after REFRESH steps of a longer one, or at the end) one M step for the output distributions. on: which positions
    count, or how much."""
    if not len(x):
        return layer
    rng = np.random.default_rng(seed)
    p = {k: v.copy() for k, v in layer.p.items()}
    out = Layer(p, layer.table.copy(), soft=np.zeros((len(layer.table), EXPERTS)))
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    perm, held = rng.permutation(len(x)), []
    batch = batch_of(x)
    per = -(-len(perm) // batch)
    common = layer.table[:, -1:].astype(np.float64)
    met, place = np.zeros(len(common), bool), np.zeros(len(common), np.int32)
    for k in range(steps):
        take = perm[(k % per) * batch : (k % per) * batch + batch]
        grads, resp = _gradients(out, x[take], y[take], on[take])
        lr = rate * (1 - k / steps) + 0.002
        which = x[take].ravel()
        # only the batch's ids have a gradient
        met[which] = True
        ids = np.flatnonzero(met)
        met[ids], place[ids] = False, np.arange(len(ids))
        at = place[which].astype(np.intp)
        g = np.stack([np.bincount(at, weights=c) for c in grads.pop("e").reshape(-1, WIDTH).T], 1).astype(np.float32)
        second = 0.9 * m2["e"].take(ids, 0) + 0.1 * g * g
        m2["e"][ids] = second
        p["e"][ids] -= lr * g / (np.sqrt(second) + 1e-6)
        for name, d in grads.items():
            m1[name] = 0.9 * m1[name] + 0.1 * d
            m2[name] = 0.99 * m2[name] + 0.01 * d * d
            p[name] -= (lr * (m1[name] / (1 - 0.9 ** (k + 1))) / (np.sqrt(m2[name] / (1 - 0.99 ** (k + 1))) + 1e-6)).astype(np.float32)
        weight = on[take].ravel()
        hit = np.flatnonzero(weight)
        held.append((y[take].ravel()[hit], (resp[:EXPERTS] * weight[hit]).astype(np.float32)))
        if (k + 1) % per == 0 or k + 1 == steps or (k % per + 1) % REFRESH == 0:
            own = np.concatenate([c for c, _ in held]).astype(np.intp)
            soft = np.stack([np.bincount(own, weights=np.concatenate([c[i] for _, c in held]), minlength=len(layer.table)) for i in range(EXPERTS)], 1)
            table = soft + PRIOR * common
            out.table = np.c_[table / table.sum(0), common].astype(np.float32)
            out.soft += soft * min(1.0, per / steps)  # windows of several passes count once
            held = []
    return out


def _pieces(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First ids of the words of texts and texts' sizes; then ids, sizes and counts of their distinct words.

    Words are cut and told apart in blocks of texts, so that what a word takes on the way is held for a block alone."""
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    found, many, span, times, where = [], [], [], [], []
    for i, j in blocks(off, BLOCK):
        start, end, row, h = words(data, off[i : j + 1])
        u, at, inv, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        span.append(np.stack([start[at], end[at]]))
        found.append(u)
        times.append(n)
        where.append(inv.astype(np.int32))
        many.append(np.bincount(row, minlength=j - i))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, at, inv = np.unique(np.concatenate(found), return_index=True, return_inverse=True)
    ids, size = subwords(cut(whole.translate(_LOWER), *np.concatenate(span, 1)[:, at]), path)
    of, begin = ids[np.cumsum(size) - size].astype(np.int32), np.cumsum([0, *map(len, found)])
    first = [of[inv[begin[b] : begin[b + 1]]][k] for b, k in enumerate(where)]
    return np.concatenate(first), np.concatenate(many), ids, size, np.bincount(inv, weights=np.concatenate(times), minlength=len(at)).astype(np.int64)


def _part(texts: list[bytes], path: str, vocab: int) -> tuple[np.ndarray, tuple, list[tuple]]:
    """Counts of the ids that each layer predicts in a part's texts, and the windows (inputs, targets, weights) of each."""
    end = vocab - 1
    first, size, ids, many, times = _pieces(texts, path)
    n = np.zeros((2, vocab))
    n[0] = np.bincount(first, minlength=vocab)
    n[0, end] += len(size)
    later = np.ones(len(ids), bool)
    later[np.cumsum(many) - many] = False
    n[1] = np.bincount(ids[later], weights=np.repeat(times, many)[later], minlength=vocab)
    n[1, end] += times.sum()
    x, y, on, _ = windows(first, size, end, back=0)  # each id is a target once and read once
    inside = [(a, b, (c * times[own][:, None]).astype(np.float32)) for a, b, c, own in inside_windows(ids, many, end)]
    return n, (x, y, on.astype(np.float32)), inside


def fitted(train: DataFrame, path: str, total: int, rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """Both layers, by federated averaging over all texts of train (text, lot: a hash), of so many words in total."""
    vocab = vocabulary(path)
    several = total > PART_WORDS
    parts = max(1, round(total / (rounds if several else 1) / PART_WORDS))
    rng = np.random.default_rng(SEED)
    start = [initial(vocab, np.zeros(vocab), rng) for _ in (0, 1)]
    names = sorted(start[0].p)
    cut = np.cumsum([start[0].p[c].size for c in names])

    def flat(p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[c].ravel() for c in names]).astype(np.float32)

    def back(v: np.ndarray) -> dict[str, np.ndarray]:
        return {c: a.reshape(start[0].p[c].shape).astype(np.float32) for c, a in zip(names, np.split(v, cut[:-1]), strict=True)}

    def layer_of(p: np.ndarray, soft: np.ndarray, n: np.ndarray) -> Layer:
        """A layer of these weights whose distributions come of responsibilities and counts; hashed shares before any."""
        common = (n + SMOOTH) / (n + SMOOTH).sum()
        table = soft + PRIOR * common[:, None] if soft.any() else common[:, None] * _lean(vocab)
        return Layer(back(p), np.c_[table / table.sum(0), common].astype(np.float32))

    state = [(flat(x.p), np.zeros((vocab, EXPERTS)), np.zeros(vocab)) for x in start]
    piece = 1 << 15
    for r in range(rounds):
        shared = train.sparkSession.sparkContext.broadcast(state)
        rate = 0.05 / (r + 1)

        def run(rows: pa.Table) -> pa.Table:
            # a part is a group by hash; its texts are read in order, so that results do not hang on the split
            n, between, inside = _part(sorted((t or "").encode() for t in rows.column("text").to_pylist()), path, vocab)
            out = []
            for k, (p, soft, known) in enumerate(shared.value):  # noqa: B023
                layer, met = layer_of(p, soft, known + n[k]), np.zeros((vocab, EXPERTS))
                for x, y, on in [between] if k == 0 else inside:
                    passes = min(4, -(-steps * batch_of(x) // max(len(x), 1)))  # a small part is read several times
                    layer = trained(layer, x, y, on, passes * -(-len(x) // batch_of(x)), rate, SEED)  # noqa: B023
                    met += layer.soft if layer.soft is not None else 0
                # changes of weights, so that what a part does not meet is zeros
                v = np.r_[flat(layer.p) - p, met.ravel().astype(np.float32), n[k].astype(np.float32)]
                v = np.r_[v, np.zeros(-len(v) % piece, v.dtype)].reshape(-1, piece)
                out += [(k, i, row.tobytes()) for i, row in enumerate(v)]
            k, i, v = zip(*out, strict=True)
            return pa.table({"k": pa.array(k, pa.int32()), "i": pa.array(i, pa.int32()), "v": pa.array(v, pa.binary())})

        def added(rows: pa.Table) -> pa.Table:
            v = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows.column("v").to_pylist())
            return pa.table({"k": rows.column("k")[:1], "i": rows.column("i")[:1], "c": pa.array([rows.num_rows], pa.int32()), "v": [v.tobytes()]})

        own = train.where(F.pmod(F.shiftright("lot", 32), F.lit(rounds)) == r) if several else train
        parted = own.groupBy(F.pmod("lot", F.lit(parts)).alias("part"))
        done = parted.applyInArrow(run, "k int, i int, v binary").groupBy("k", "i").applyInArrow(added, "k int, i int, c int, v binary").toArrow().to_pylist()  # twice as large as the layers
        for k in (0, 1):
            mine = sorted((x for x in done if x["k"] == k), key=lambda x: x["i"])
            if mine:
                v = np.frombuffer(b"".join(x["v"] for x in mine))
                p, soft, known = state[k]
                met, n = v[len(p) : len(p) + soft.size].reshape(soft.shape), v[len(p) + soft.size :][:vocab]
                # rounds over the same texts replace each other, those over shares add up
                state[k] = ((p + v[: len(p)] / mine[0]["c"]).astype(np.float32), met + soft * several, n + known * several)
        shared.unpersist()
    return Model(*(layer_of(*x) for x in state), path)


def memory_counts(docs: DataFrame) -> DataFrame:
    """k, h, c: hash and count of every word (k = 0) and of every chunk (k = 1) of the training texts, and under
    k = 2 the ends (one a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        room = n = 0
        for b in batches:
            data, off = utf8(b.column(0))
            n += b.num_rows
            for i, j in blocks(off, BLOCK):
                _, _, row, h = words(data, off[i : j + 1])
                u, inv, c = np.unique(h, return_inverse=True, return_counts=True)
                held[0].append((u, c))
                held[1].append(np.unique(chunks(h, row, j - i, (mix64(u) % np.uint64(CHUNK) == 0)[inv])[2], return_counts=True))
                room += len(u) + len(held[1][-1][0])
            if room > FLUSH:
                yield from (_counts(k, x) for k, x in enumerate(held) if x)
                held, room = [[], []], 0
        yield from (_counts(k, x) for k, x in enumerate(held) if x)
        yield _counts(2, [(np.zeros(1, np.uint64), np.array([n]))])

    train = docs.where(~F.col("held")).select("text")
    return stored(train.mapInArrow(run, COUNTS).groupBy("k", "h").agg(F.sum("c").alias("c")), "words")


def _counts(k: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    c = np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], schema=arrow(COUNTS))


def mixed(log_model: np.ndarray, frequency: np.ndarray, share: float) -> np.ndarray:
    """log10 of so much of a frequency and the rest of the model's probability: both sum to one at most."""
    return np.where(frequency > 0, np.log10(share * frequency + (1 - share) * 10.0 ** np.maximum(log_model, -300)), np.log10(1 - share) + log_model)


_models: dict[int, Model] = {}


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Null and empty texts are the end alone. A null id counts as '' for held_out. Repeated rows score alike,
    and those that train count as often as they occur. Without training texts the model is its untrained start.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("held", fold(F.col("doc_id"), FOLDS_LM) == 0)
    counts = memory_counts(docs)
    sums = {r["k"]: r for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    of = lambda k, c: int(sums[k][c]) if k in sums else 0
    ends, pieces, distinct = of(2, "c"), of(1, "c"), of(0, "n") + (of(2, "c") > 0)
    total = of(0, "c") + ends
    floors = [max(1, total / HOT), max(1, pieces / HOT)]
    is_hot = ((F.col("k") == 0) & (F.col("c") >= floors[0])) | ((F.col("k") == 1) & (F.col("c") >= floors[1]))
    table = counts.where(is_hot).toArrow()  # at most HOT words and HOT chunks: each has at least a HOT-th of all

    def sorted_hot(k: int) -> tuple[np.ndarray, np.ndarray]:
        on = table.column("k").to_numpy() == k
        h, c = table.column("h").to_numpy()[on].view(np.uint64), table.column("c").to_numpy()[on]
        order = np.argsort(h)
        return np.r_[h[order], np.uint64(2**64 - 1)], np.r_[c[order], 0]

    model = fitted(docs.where(~F.col("held")).select("text", F.xxhash64("doc_id", "text").alias("lot")), path, total)
    shared = spark.sparkContext.broadcast((sorted_hot(0), sorted_hot(1), model))
    whole = float(np.log10(total + SMOOTH * (distinct + 1))) if total else float(np.log10(SMOOTH))
    end_log, none = float(np.log10(ends + SMOOTH)), float(np.log10(SMOOTH))
    token = int(np.random.default_rng().integers(1 << 62))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot_h, hot_c), (hot_g, hot_n), fresh = shared.value
        if token not in _models:  # what a worker knows of words outlives a task
            _models.clear()
            _models[token] = replace(fresh)
        model = _models[token]
        end = len(model.between.table) - 1
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in blocks(off, BLOCK):
                part, n = data[off[i] : off[j]], j - i
                start, stop, row, h = words(part, off[i : j + 1] - off[i])
                u, at, inv = np.unique(h, return_index=True, return_inverse=True)
                raw = part.tobytes().translate(_LOWER)
                first, rest = model.lookup(u, lambda new, a=at, r=raw, s=start, e=stop: cut(r, s[a[new]], e[a[new]]))
                size = np.bincount(row, minlength=n)
                logs = model.between.log10(*windows(first[inv], size, end)[:3])
                last = np.cumsum(size + 1) - 1
                k = np.searchsorted(hot_h, u)
                hit = hot_h[k] == u
                often = np.where(hit, hot_c[k], 0)
                by_word = mixed(np.delete(logs, last) + rest[inv], (often / max(total, 1))[inv], WORD_SHARE)
                index, text, key = chunks(h, row, n, (mix64(u) % np.uint64(CHUNK) == 0)[inv])
                of_end = mixed(logs[last], np.full(n, ends / max(total, 1)), WORD_SHARE)
                by_chunk = np.bincount(index, weights=by_word, minlength=len(key)).astype(float)
                by_chunk[len(key) - (size == 0).sum() :] += of_end[size == 0]
                if len(h):
                    by_chunk[index[(np.cumsum(size) - 1)[size > 0]]] += of_end[size > 0]
                held = b.column(2).to_numpy(zero_copy_only=False)[i:j]
                g = np.searchsorted(hot_g, key)
                known = hot_g[g] == key
                seen = np.where(known, hot_n[g] - ~held[text], 0)  # a training text's own chunk is taken off
                score = np.bincount(text, weights=mixed(by_chunk, seen / max(pieces, 1), CHUNK_SHARE), minlength=n)
                in_hot = hit[inv]
                log_of = np.log10(often + SMOOTH)
                log_sum = 1.0 * np.bincount(row[in_hot], weights=log_of[inv][in_hot], minlength=n) + end_log + none * np.bincount(row[~in_hot], minlength=n)
                # the rest of words, once a text with how often they occur, and of chunks with their probability
                r, w = row[~in_hot], inv[~in_hot]
                pair, times = np.unique(r * np.int64(len(u) + 1) + w, return_counts=True)
                r, w = pair // (len(u) + 1), u[pair % (len(u) + 1)] if len(u) else np.zeros(0, np.uint64)
                own = np.r_[r, text[~known]]
                order = np.argsort(own, kind="stable")
                bound = pa.array(np.r_[0, np.cumsum(np.bincount(own, minlength=n))].astype(np.int32))
                cells = [np.r_[np.zeros(len(r), np.int32), np.where(held[text[~known]], 2, 1).astype(np.int32)], np.r_[w, key[~known]].view(np.int64), np.r_[times, by_chunk[~known]].astype(np.float32)]
                lists = [pa.ListArray.from_arrays(bound, pa.array(x[order])) for x in cells]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(2).slice(i, n), pa.array(size + 1), pa.array(np.bincount(row[in_hot], minlength=n) + (ends > 0)), pa.array(log_sum), pa.array(score), *lists], names=["doc_id", "held", "n_tokens", "n_known", "log_sum", "score", "k", "h", "m"])

    scored = stored(docs.select("doc_id", "text", "held").mapInArrow(run, PART).withColumn("row", F.monotonically_increasing_id()), "scored")
    # a row's number and the kind are one value, so that little is shuffled: 0 a word, 1 a chunk of a training text, 2 of another
    rest = scored.select("row", F.explode(F.arrays_zip("k", "h", "m")).alias("x")).select((F.col("row") * 4 + F.col("x.k")).alias("cell"), "x.h", "x.m")
    rest = rest.join(counts.where(~is_hot & (F.col("k") < 2)).select("h", "c"), "h").withColumn("m", F.col("m").cast("double"))
    kind = F.pmod("cell", F.lit(4))
    is_word = kind == 0
    c = F.when(kind == 1, F.col("c") - 1).otherwise(F.col("c"))
    plain = F.log10(F.lit(1 - CHUNK_SHARE)) + F.col("m")
    better = F.log10(F.lit(CHUNK_SHARE / max(pieces, 1)) * c + F.lit(1 - CHUNK_SHARE) * F.pow(F.lit(10.0), F.greatest("m", F.lit(-300.0)))) - plain
    rest = rest.withColumn("row", F.shiftright("cell", 2))
    sums_of = rest.groupBy("row").agg(
        F.sum(F.when(is_word, F.col("m") * (F.log10(c + F.lit(SMOOTH)) - F.lit(none)))).alias("more"),
        F.sum(F.when(is_word, F.col("m"))).cast("long").alias("more_known"),
        F.sum(F.when(~is_word & (c > 0), better)).alias("recalled"),
    )
    out = scored.drop("k", "h", "m").join(sums_of, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("more", zero) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("score") + F.coalesce("recalled", zero)).alias("score"),
    )
