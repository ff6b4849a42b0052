"""Byte-level BPE of a public vocabulary file, for operators whose subject is not encoding itself."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

from .bpe import stand_ins

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Ids of texts, and the bytes of every id, of one vocabulary file (ids are ranks of merges)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        byte = {c: b for b, c in enumerate(stand_ins())}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.coder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for token, i in ranks.items():
            self.token[i] = token
        for token, i in self.special.items():
            self.token[i] = token.encode()

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in which strings of special tokens are ordinary text."""
        return self.coder.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text in which strings of special tokens are these tokens."""
        return self.coder.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
