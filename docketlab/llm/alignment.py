"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes, in groups and links.

Each text is encoded once by both. B's tokens of a batch of texts lie in one static interval index (their sorted
starts and ends); for each A token two bisections give the run of B tokens that it overlaps. Gaps between
neighbouring B tokens that no A token spans are the boundaries of groups.

Counts of linked id pairs over the corpus are summed by tasks first and then by pair. Going back to documents,
the pairs of at least 1 / COMMON of all links (so COMMON at most) are looked up inside the tasks; the
others, which few documents share, are joined by a shuffle on the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .bpe import text_batches
from .common import modest_batches, partitions, stored

#: The piece that starts words, and the form of byte pieces.
WORD_START, BYTE_PIECE = "▁", ("<0x", ">")
#: A pair with this share of all links or more is looked up inside tasks (12 MB at most).
COMMON = 1 << 19
#: Links gathered before a task sums them up by pair.
GATHERED = 1 << 23

DOCS = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"
PAIRS = "pair long, links long"
PARTS = "uid long, n_best long, count_sum long, pairs array<long>, links array<int>"
_DOCS = pa.schema([*((c, pa.int64()) for c in ("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int32()))])
_PAIRS = pa.schema([("pair", pa.int64()), ("links", pa.int64())])
_PARTS = pa.schema([*((c, pa.int64()) for c in ("uid", "n_best", "count_sum")), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int32()))])


class Two:
    """Both vocabularies: encoders, bytes and lengths of tokens, and the ids' decimals with their separators."""

    def __init__(self, a_path: str, b_path: str):
        self.a = byte_bpe.coder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = self.a.token, [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # by id and whether the token ends its group
        self.a_text = np.array([f"{i}{s}" for i in range(len(self.a_bytes)) for s in ",|"], object)
        self.b_text = np.array([f"{i}{s}" for i in range(len(self.b_bytes)) for s in ",;"], object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[len(BYTE_PIECE[0]) : -len(BYTE_PIECE[1])], 16)])
        return piece.replace(WORD_START, " ").encode()


@lru_cache(maxsize=2)
def two(a_path: str, b_path: str) -> Two:
    return Two(a_path, b_path)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return byte_bpe.default_path(), public_tokenizers.path("piece_bpe_32k.model")


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the B tokens that each A token overlaps. Tokens of either side follow each other
    without gaps from byte 0 and are not empty; ends ascend. The static index is B's sorted starts and ends."""
    a_start, b_start = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
    return np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left") - 1


def closing(first: np.ndarray, last: np.ndarray, n_b: int) -> np.ndarray:
    """Whether each B token ends a group: no A token spans the gap after it."""
    spans = np.zeros(n_b + 1, np.int64)
    np.add.at(spans, first, 1)
    np.add.at(spans, last, -1)
    return np.cumsum(spans[:n_b]) == 0


def _aligned(v: Two, texts: list[str]) -> Iterator[tuple]:
    """For each text (n_a, n_b, n_groups, n_links, groups_sha256, pairs, links); pairs are a * |B| + b, ascending."""
    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
    raw = [(" " + t).encode() if t else b"" for t in texts]
    a = [v.a.plain(" " + t) if t else np.zeros(0, np.uint32) for t in texts]
    b = [np.array(x, np.int64) for x in v.b.encode(texts, num_threads=1)]
    same = [bool(t) and b"".join(map(v.b_bytes.__getitem__, y.tolist())) == r and b"".join(map(v.a_bytes.__getitem__, x.tolist())) == r for t, r, x, y in zip(texts, raw, a, b, strict=True)]
    kept = [i for i, ok in enumerate(same) if ok]
    if not kept:
        yield from (none for _ in texts)
        return
    a_ids, b_ids = np.concatenate([a[i] for i in kept]).astype(np.int64), np.concatenate([b[i] for i in kept])
    n_a, n_b = (np.array([len(x[i]) for i in kept]) for x in (a, b))
    a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
    first, last = overlaps(np.cumsum(v.a_size[a_ids]), np.cumsum(v.b_size[b_ids]))
    # texts meet at common ends, so no group and no link crosses from one to the next
    b_closes = closing(first, last, len(b_ids))
    group = np.cumsum(b_closes) - b_closes
    a_group = group[first]
    a_closes = np.append(a_group[1:] != a_group[:-1], True)
    # all tokens in the order of the written form: a group's A tokens, then its B tokens
    written = np.empty(len(a_ids) + len(b_ids), object)
    a_before, b_before = np.flatnonzero(a_closes) + 1, np.flatnonzero(b_closes) + 1
    written[np.arange(len(a_ids)) + np.append(0, b_before)[a_group]] = v.a_text[a_ids * 2 + a_closes]
    written[np.arange(len(b_ids)) + a_before[group]] = v.b_text[b_ids * 2 + b_closes]
    text_to = a_to + b_to
    # links as pairs, counted within each text
    each = last - first + 1
    link_a = np.repeat(np.arange(len(a_ids)), each)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(each) - each, each) + first[link_a]
    owner = np.searchsorted(a_to, np.arange(len(a_ids)), "right")
    space = len(v.a_bytes) * len(v.b_bytes)
    key = owner[link_a] * space + a_ids[link_a] * len(v.b_bytes) + b_ids[link_b]
    key, links = np.unique(key, return_counts=True)
    at = np.searchsorted(key, np.arange(1, len(kept) + 1) * space)
    n_groups = np.diff(np.append(0, np.cumsum(b_closes)[b_to - 1]))
    n_links = np.diff(np.append(0, np.cumsum(each)[a_to - 1]))
    pair, links = key % space, links.astype(np.int32)
    out = dict.fromkeys(range(len(texts)), none)
    parts = written.tolist()
    for k, i in enumerate(kept):
        lo, hi = (text_to[k - 1], at[k - 1]) if k else (0, 0)
        form = "".join(parts[lo : text_to[k]])[:-1]
        out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(form.encode()).hexdigest(), pair[hi : at[k]], links[hi : at[k]])
    yield from (out[i] for i in range(len(texts)))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])), pa.int32()), pa.array(flat, kind))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the n+1 bounds of its rows in them."""
    off = np.asarray(column.offsets)
    return np.asarray(column.values)[off[0] : off[-1]], off - off[0]


def documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each row's tokens, groups and links, and its distinct linked pairs with their number of links."""
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = two(a_path, b_path)
        for batch in batches:
            for lo, texts in text_batches(batch.column(2)):
                cols = list(zip(*_aligned(v, texts), strict=True))
                keys = [batch.column(k).slice(lo, len(texts)).cast(pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), _lists(cols[5], pa.int64()), _lists(cols[6], pa.int32())], schema=_DOCS)

    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, DOCS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, links: the links of each id pair over all documents, summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pair, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def given(pair: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pair), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + (1 << 16)]), pa.array(links[i : i + (1 << 16)])], schema=_PAIRS)

        for batch in batches:
            held.append((_flat(batch.column(0))[0], _flat(batch.column(1))[0].astype(np.int64)))
            size += len(held[-1][0])
            if size > GATHERED:
                pair, links = summed()
                if len(pair) > GATHERED // 2:
                    yield from given(pair, links)
                    held, size = [], 0
                else:
                    held, size = [(pair, links)], len(pair)
        if held:
            yield from given(*summed())

    return aligned.select("pairs", "links").mapInArrow(run, PAIRS).groupBy("pair").agg(F.sum("links").alias("links"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Strings of special tokens are plain text. Null and empty texts, and texts whose tokens' bytes differ from the
    space and the text, have no tokens: zeros and ''. Rows that repeat count each; null ids stay null; other
    columns are not read. An empty table gives no rows.
    """
    default = default_paths()
    a_path, b_path = a_path or default[0], b_path or default[1]
    spark = docs.sparkSession
    n_b = len(two(a_path, b_path).b_bytes)
    aligned = stored(documents(docs, a_path, b_path), "aligned")
    counts = stored(pair_counts(aligned), "pair-links")
    best = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("links").alias("most"))  # as many rows as B has ids
    counts = stored(counts.join(F.broadcast(best), F.col("pair") % n_b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "pair-best")
    total = counts.agg(F.sum("links")).first()[0] or 0
    least = max(1, -(-total // COMMON))
    common = counts.where(F.col("links") >= least).toArrow().sort_by("pair")  # COMMON rows at most: they have 1 / COMMON of all links each
    pairs, links, bests = (np.asarray(common.column(c).combine_chunks()) if c != "best" else common.column(c).to_numpy() for c in ("pair", "links", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, bound = _flat(batch.column(1))
            times = _flat(batch.column(2))[0]
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count, is_best = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
            count[known], is_best[known] = links[at[known]], bests[at[known]]
            upto = lambda x: np.append(0, np.cumsum(x))[bound]
            left, cut = ~known, upto(~known)
            rest = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[left], kind)) for x, kind in ((pair, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(upto(times * is_best)), pa.int64()), pa.array(np.diff(upto(times * count)), pa.int64()), *rest], schema=_PARTS)

    parts = stored(aligned.select("uid", "pairs", "links").mapInArrow(run, PARTS), "aligned-common")
    rare = parts.select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("uid", "x.pairs", F.col("x.links").alias("times"))
    found = rare.join(counts.where(F.col("links") < least).hint("shuffle_hash"), rare["pairs"] == F.col("pair"))
    of_rare = found.select("uid", (F.col("times") * F.col("best").cast("int")).cast("long").alias("n_best"), (F.col("times") * F.col("links")).alias("count_sum"))
    sums = parts.select("uid", "n_best", "count_sum").unionByName(of_rare).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "links").join(sums, "uid").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
