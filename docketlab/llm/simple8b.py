"""Simple-8b word-aligned coding of token ids, vectorised over blocks.

A 64-bit word has a selector in its top four bits and 60 bits of payload: selectors 1 to 14 pack 1, 2, 3, 4, 5, 6,
7, 8, 10, 12, 15, 20, 30 or 60 ids of equal width. Selector 0 is an escape: its payload is a place in a list of
raw 64-bit ids, for ids of over 60 bits. Ids lie in blocks of BLOCK; no word crosses a block, and the first word
of each block is kept, so that any range of ids is decoded from its own blocks.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BLOCK = 256
#: Ids in a word by selector; selector 0 is the escape. The width is 60 // count.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = 60 // COUNTS
PAYLOAD = np.uint64((1 << 60) - 1)
MAGIC = b"TIDS"
#: Magic, ids a block, documents, ids, words, escapes, crc32 of what follows.
HEADER = struct.Struct("<4sIQQQQI")


@dataclass
class Packed:
    """Words of n ids, the first word of each block (and their number, last), and escaped ids."""

    n: int
    words: np.ndarray
    first: np.ndarray
    escapes: np.ndarray


def pack(ids: np.ndarray) -> Packed:
    """Codes ids (any unsigned 64-bit values): each word takes as many of its block's ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return Packed(0, np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64))
    # how many of the widths each id exceeds, in rows of a block; what follows a block counts as fitting
    need = np.zeros(blocks * BLOCK, np.uint8)
    for s in range(14, 0, -1):
        need[:n] += ids >= np.uint64(1) << np.uint64(WIDTHS[s])
    need = np.pad(need.reshape(blocks, BLOCK), ((0, 0), (0, 60)))
    best = np.zeros((blocks, BLOCK), np.uint8)
    widest, reach = need, 1  # widest[:, i]: the greatest need of the reach ids from i
    for s in range(1, 15):
        while reach < COUNTS[s]:
            step = min(reach, COUNTS[s] - reach)
            widest = np.maximum(widest[:, :-step], widest[:, step:])
            reach += step
        best[widest[:, :BLOCK] <= 14 - s] = s
    # all blocks take their next word at once
    block, at = np.arange(blocks), np.zeros(blocks, np.int64)
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    places, picks, owners = [], [], []
    while len(at):
        pick = best[block, at]
        places.append(block * BLOCK + at)
        picks.append(pick)
        owners.append(block)
        at = at + COUNTS[pick]
        more = at < size
        if not more.all():
            at, size, block = at[more], size[more], block[more]
    place, pick, owner = np.concatenate(places), np.concatenate(picks), np.concatenate(owners)
    order = np.argsort(place, kind="stable")
    place, pick = place[order], pick[order]
    words = pick.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in range(1, 15):
        rows = np.flatnonzero(pick == s)
        if len(rows):
            lane = np.arange(COUNTS[s])
            index = place[rows, None] + lane
            values = padded[index]
            values[index // BLOCK != place[rows, None] // BLOCK] = 0
            words[rows] |= np.bitwise_or.reduce(values << (lane * WIDTHS[s]).astype(np.uint64), axis=1)
    rows = np.flatnonzero(pick == 0)
    words[rows] = np.arange(len(rows), dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))]).astype(np.uint32)
    return Packed(n, words, first, ids[place[rows]])


def unpack(packed: Packed, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop, from the blocks that hold them."""
    stop = packed.n if stop is None else min(stop, packed.n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    b0, b1 = start // BLOCK, -(-stop // BLOCK)
    bound = packed.first[b0 : b1 + 1].astype(np.int64)
    words = packed.words[bound[0] : bound[-1]]
    pick = (words >> np.uint64(60)).astype(np.int64)
    size = COUNTS[pick]
    # where each word's first id goes: blocks are full but for the last, whose last word may run over
    before = np.concatenate([[0], np.cumsum(size)])
    own = bound - bound[0]
    block = np.repeat(np.arange(b1 - b0), np.diff(own))
    place = before[:-1] - before[own[:-1]][block] + block * BLOCK
    out = np.zeros((b1 - b0) * BLOCK + 60, np.uint64)
    for s in range(1, 15):
        rows = np.flatnonzero(pick == s)
        if len(rows):
            lane = np.arange(COUNTS[s])
            index = place[rows, None] + lane
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            values = ((words[rows, None] & PAYLOAD) >> (lane * WIDTHS[s]).astype(np.uint64)) & mask
            inside = index < (block[rows, None] + 1) * BLOCK
            out[index[inside]] = values[inside]
    rows = np.flatnonzero(pick == 0)
    out[place[rows]] = packed.escapes[(words[rows] & PAYLOAD).astype(np.int64)]
    return out[start - b0 * BLOCK : stop - b0 * BLOCK]


def to_bytes(doc_id: np.ndarray, valid: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, first words of blocks, the documents' ids, validity and numbers of tokens, words, escapes."""
    p = pack(ids)
    body = b"".join([p.first.astype("<u4").tobytes(), doc_id.astype("<i8").tobytes(), valid.astype("u1").tobytes(), sizes.astype("<u8").tobytes(), p.words.astype("<u8").tobytes(), p.escapes.astype("<u8").tobytes()])
    return HEADER.pack(MAGIC, BLOCK, len(sizes), p.n, len(p.words), len(p.escapes), zlib.crc32(body)) + body


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Packed]:
    """doc_id, validity and number of tokens of each document, and the coded ids. A damaged file raises ValueError."""
    if len(data) < HEADER.size:
        raise ValueError("not a whole file of token ids")
    magic, block, docs, n, n_words, n_escapes, crc = HEADER.unpack_from(data)
    if magic != MAGIC or block != BLOCK or zlib.crc32(memoryview(data)[HEADER.size :]) != crc:
        raise ValueError("not a whole file of token ids")
    parts, at = [], HEADER.size
    for kind, count in (("<u4", -(-n // BLOCK) + 1), ("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", n_words), ("<u8", n_escapes)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    first, doc_id, valid, sizes, words, escapes = parts
    return doc_id, valid.astype(bool), sizes.astype(np.int64), Packed(n, words, first, escapes)
