"""BPE encoding and decoding with a public vocabulary of words with ends, by batched numpy merge rounds.

Texts are split at white space, and each distinct chunk is encoded once per worker: chunks that are not
known yet are normalised, cut into pieces, and all new pieces of a batch go through the merges together.
Their symbols lie in one flat array; each round finds every adjacent pair's rank by binary search over the
sorted pair keys, takes the lowest rank of each piece, and merges all its occurrences from the left.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow, modest_batches

#: Fixed values of the file format: the split pattern, the white space, and the printable stand-ins of bytes.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+")
BLANK = regex.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
END = "</w>"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Chunks a worker keeps; beyond it the cache starts anew (results do not depend on it).
CACHE_ROWS, CACHE_CHARS = 250_000, 64
_IDS, _TEXT = itemgetter(0), itemgetter(1)
NO_RANK = np.iinfo(np.int64).max


def stand_ins() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        chars = stand_ins()
        self.byte = np.array([vocab[c] for c in chars])
        self.last = np.array([vocab[c + END] for c in chars])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs])
        self.known: dict[str, tuple[bytes, str]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (non-empty byte strings) in one array, and the bounds of each piece in it."""
        size = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.byte[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(pieces)), size)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.full(len(sym), NO_RANK)
            if len(sym) > 1:
                key = (sym[:-1] << 32) | sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
                rank[:-1][hit] = self.rank[at[hit]]
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, start)
            lows = np.repeat(low, np.diff(np.r_[start, len(sym)]))
            done = lows == NO_RANK
            parts.append((owner[done], sym[done]))
            pick = (rank == lows) & ~done
            at = np.flatnonzero(pick)
            if len(at):  # of a run of overlapping occurrences (aaa), every other one from the left
                run = np.r_[True, np.diff(at) != 1]
                first = at[np.flatnonzero(run)][np.cumsum(run) - 1]
                at = at[(at - first) % 2 == 0]
                sym[at] = self.merged[rank[at]]
                keep = ~done
                keep[at + 1] = False
            else:
                keep = ~done
            sym, owner = sym[keep], owner[keep]
        owner = np.concatenate([p[0] for p in parts])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate([p[1] for p in parts])[order]
        return ids, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(pieces)))]

    def _cut(self, chunk: str) -> list[int | bytes]:
        """The chunk's special ids and the bytes of its pieces, in order."""
        if chunk.isascii():  # the common cases: letters, then perhaps one mark
            if chunk.isalpha():
                return [chunk.lower().encode()]
            if chunk[-1] in ".,!|" and chunk[:-1].isalpha():
                return [chunk[:-1].lower().encode(), chunk[-1].encode()]
        out: list[int | bytes] = []
        for part in self.marks.split(chunk) if self.marks and "<" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                text = part if part.isascii() else unicodedata.normalize("NFC", part)
                # character by character: no rule here looks at a letter's neighbours
                text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
                out += [p.encode("utf-8", "surrogatepass") for p in PIECE.findall(text)]
        return out

    def learn(self, chunks: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Little-endian ids and decoded text of each chunk."""
        cut = {c: self._cut(c) for c in chunks}
        pieces = list({p for parts in cut.values() for p in parts if isinstance(p, bytes)})
        done: dict[int | bytes, tuple[bytes, str]] = {i: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}
        if pieces:
            ids, bound = self.encode_pieces(pieces)
            raw, tokens, at = ids.astype("<u4").tobytes(), [self.token[i] for i in ids.tolist()], bound.tolist()
            done |= {p: (raw[4 * i : 4 * j], " ".join(tokens[i:j])) for p, i, j in zip(pieces, at[:-1], at[1:], strict=True)}
        return {c: done[parts[0]] if len(parts) == 1 else (b"".join(done[p][0] for p in parts), " ".join(done[p][1] for p in parts)) for c, parts in cut.items()}

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so tokens are joined by single spaces; special tokens stay."""
        return " ".join(self.token[int(i)] for i in ids)

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        # str.split() also splits at 1C-1F, which are no white space in the pattern
        split = [t.split() if not any(c in t for c in "\x1c\x1d\x1e\x1f") else [c for c in BLANK.split(t) if c] for t in texts]
        if len(self.known) > CACHE_ROWS:
            self.known.clear()
        known = self.known
        new = set().union(*split).difference(known)
        known.update(self.learn(new))
        for chunks in split:
            got = list(map(known.__getitem__, chunks))
            yield b"".join(map(_IDS, got)), " ".join(filter(None, map(_TEXT, got)))
        for c in new:
            if len(c) > CACHE_CHARS:
                del known[c]


@lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_batches(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `size` characters, with the first one's row; nulls are empty."""
    rows, chars, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        rows.append(t)
        chars += len(t)
        if chars >= size:
            yield first, rows
            rows, chars, first = [], 0, i + 1
    if rows:
        yield first, rows


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text; no shuffle.

    Null and empty texts have no tokens. Rows that repeat are encoded alike; null ids stay null; other
    columns are not read. Surrogate code points cannot occur in Spark strings.
    """
    modest_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = coder(path), arrow(SCHEMA)
        for batch in batches:
            n, a, b = [], [], []
            for _, texts in text_batches(batch.column(1)):
                for ids, text in bpe.encode_batch(texts):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=schema)
        # the worker lives on, perhaps for other work: it keeps the vocabulary, not the chunks
        bpe.known.clear()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
