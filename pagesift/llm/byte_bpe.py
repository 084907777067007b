"""Byte-level BPE ids of whole texts, for the operators that work on token sequences.

The vocabulary is a file of ranks: a token's bytes in base64 and its id, per line. Names of special tokens in a text are ordinary text, unless they are given with their ids: then each is that one id, as in the tokenizer library.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken


#: (name, id) of the special tokens that texts may hold
Specials = tuple[tuple[str, int], ...]


class ByteBpe:
    def __init__(self, path: str, pattern: str, specials: Specials = ()):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))
        self.names = {name for name, _ in specials}

    def ids(self, body: bytes) -> np.ndarray:
        return np.array(self.encoding.encode(body.decode("utf-8", "replace"), allowed_special=self.names, disallowed_special=()), np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str, specials: Specials = ()) -> ByteBpe:
    """One encoder per worker and vocabulary."""
    return ByteBpe(path, pattern, specials)
