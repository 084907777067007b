"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here as the model says: at each place the longest key of the compiled character map (a double-array
trie) is replaced, other characters stay, spaces are squeezed and marked. Every normalised byte records the byte of the
original text at which its source begins. The library finds the pieces; their lengths, laid end to end over the normalised bytes, project
each piece to a span of bytes of the original text. Pieces of one character that fell back to bytes: the last one has the
character's span, the others are empty. A text whose pieces don't add up to its normalised bytes is an error.

Where the model's pieces allow it (no key in the map, spaces only open a piece), a text is encoded word by word with a bounded
memory of words, which gives the library's ids for the whole text.

Null and empty texts have no pieces and decode to an empty text. Bytes that are no UTF-8 count as U+FFFD. Equal texts give equal rows.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame

from pagesift.llm.common import map_text, text_of

#: words whose ids a worker remembers, at most
WORDS = 400_000

ENCODED = "ids array<int>, starts array<int>, ends array<int>, decoded string"
MARK = "▁".encode()


class CharacterMap:
    """The compiled map of a model: a double-array trie, and the replacements its leaves point to."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]
        opening = bytes(c for c in range(256) if self.units and self._child(self._below(0, self.units[0]), c) is not None)
        self.opening = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in opening) + b"]") if opening else None

    @staticmethod
    def _below(at: int, unit: int) -> int:
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _child(self, at: int, byte: int) -> int | None:
        """The place of the node that ``byte`` leads to, if any."""
        at ^= byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``start``, and what replaces it."""
        at, found = self._below(0, self.units[0]), None
        for i in range(start, len(text)):
            node = self._child(at, text[i])
            if node is None:
                break
            unit = self.units[node]
            at = self._below(node, unit)
            if unit >> 8 & 1:
                value = self.units[at] & 0x7FFFFFFF
                found = i + 1 - start, value
        if not found:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def aligned(text: bytes, mapping: CharacterMap) -> tuple[np.ndarray, np.ndarray]:
    """The mapped bytes, and for each the place in ``text`` at which its source begins."""
    raw = np.frombuffer(text, np.uint8)
    begins = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
    if mapping.opening is None:
        return raw, begins
    made, source, at, look = [], [], 0, 0
    while hit := mapping.opening.search(text, look):
        start = hit.start()
        found = mapping.longest(text, start) if begins[start] == start else None
        if found is None:
            look = start + 1
            continue
        size, new = found
        made += [raw[at:start], np.frombuffer(new, np.uint8)]
        source += [begins[at:start], np.full(len(new), start)]
        at = look = start + size
    made.append(raw[at:])
    source.append(begins[at:])
    return np.concatenate(made), np.concatenate(source).astype(np.int64)


class Codec:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = _spec(self.model.serialized_model_proto())
        self.map = CharacterMap(spec["map"])
        self.prefix, self.squeeze, self.escape, self.suffix = spec["prefix"], spec["squeeze"], spec["escape"], spec["suffix"]
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.sizes = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        inner = any("▁" in p.lstrip("▁") for p in pieces)
        self.by_word = self.map.opening is None and self.prefix and self.escape and not (self.squeeze or self.suffix or inner)
        self.words: dict[str, bytes] = {}

    def normalized(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes and, for each and for their end, the place in ``text``."""
        if not text:
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        made, source = aligned(text, self.map)
        end, first = len(text), 0
        if self.squeeze:
            space = made == 32
            keep = ~(space & np.append(True, space[:-1]))
            leading = len(made) if space.all() else int(np.argmin(space))
            if leading == len(made):
                return np.zeros(0, np.uint8), np.zeros(1, np.int64)
            first = int(source[leading])
            made, source = made[keep], source[keep]
        if self.prefix and not self.suffix:
            made, source = np.append(32, made), np.append(first, source)
        mark = MARK if self.escape else b" "
        if self.escape:
            space = made == 32
            times = np.where(space, 3, 1)
            at = np.cumsum(times) - times
            made, source = np.repeat(made, times), np.repeat(source, times)
            for j, byte in enumerate(MARK):
                made[at[space] + j] = byte
        if self.squeeze:
            size = len(made.astype(np.uint8).tobytes().removesuffix(mark))
            while size < len(made):  # marks that stood in the text go too
                end, made, source = int(source[size]), made[:size], source[:size]
                size = len(made.astype(np.uint8).tobytes().removesuffix(mark))
        if self.prefix and self.suffix:
            made, source = np.append(made, list(mark)), np.append(source, [end] * len(mark))
        return made.astype(np.uint8), np.append(source, end)

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word or "▁" in text:
            return np.array(self.model.encode(text), np.int32)
        if not text:
            return np.zeros(0, np.int32)
        words = text.split(" ")
        if "" in words:  # several spaces in a row, or one at an end, go with the word that follows
            words = [w[1:] for w in re.findall(r" +[^ ]*", " " + text)]
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            new = list({w for w, f in zip(words, found) if f is None})
            made = {w: array("i", x).tobytes() for w, x in zip(new, self.model.encode(new, num_threads=1))}
            if "" in made:
                made[""] = array("i", [self.model.piece_to_id("▁")]).tobytes()
            if len(known) < WORDS:
                known.update(made)
            found = [f if f is not None else made[w] for w, f in zip(words, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made, source = self.normalized(text)
        ends = np.cumsum(self.sizes[ids])
        if (ends[-1] if len(ends) else 0) != len(made):
            raise ValueError("the pieces don't add up to the normalised text")
        return source[ends - self.sizes[ids]].astype(np.int32), source[ends].astype(np.int32)

    def spans_of_all(self, texts: list[bytes], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``spans`` of many texts, end to end. Without a character map all of them are projected at once."""
        if not self.by_word:
            parts = [self.spans(t, i) for t, i in zip(texts, ids)]
            return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))
        texts = [b" " + t if t else b"" for t in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        places = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.arange(len(raw), dtype=np.int32)
        if (raw > 127).any():
            begins = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, begins, 0), dtype=np.int32)
        source = np.append(np.repeat(begins, np.where(raw == 32, 3, 1)), np.int32(len(raw)))
        sizes = self.sizes[np.concatenate(ids)]
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(source) - 1:
            raise ValueError("the pieces don't add up to the normalised text")
        owner = np.repeat(places + 1, [len(i) for i in ids])
        return np.maximum(source[ends - sizes] - owner, 0).astype(np.int32), (source[ends] - owner).astype(np.int32)

    def encode(self, bodies: list[bytes]) -> dict[str, pa.Array]:
        texts = [body.decode("utf-8", "replace") for body in bodies]
        ids = [self.ids(text) for text in texts]
        starts, ends = self.spans_of_all([text.encode() for text in texts], ids)
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32))
        return {
            "ids": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
            "starts": pa.ListArray.from_arrays(offsets, pa.array(starts)),
            "ends": pa.ListArray.from_arrays(offsets, pa.array(ends)),
            "decoded": pa.array(self.model.decode(ids, num_threads=1), pa.string()),
        }


def _fields(data: bytes) -> list[tuple[int, object]]:
    """Field numbers and values of a serialised message."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else 0)
        out.append((tag >> 3, data[at : at + size] if kind else varint()))
        at += size
    return out


def _spec(model: bytes) -> dict:
    """How the model normalises. Field numbers of the public model format; what is absent has the format's defaults."""
    top = _fields(model)
    last = {number: value for number, value in top if number in (2, 3)}
    trainer, normalizer = dict(_fields(last.get(2, b""))), dict(_fields(last.get(3, b"")))
    kinds = {dict(_fields(v)).get(3, 1) for n, v in top if n == 1}
    if 4 in kinds:
        raise ValueError("models with user-defined pieces are not supported")
    if not trainer.get(35, 0):
        raise ValueError("a model without byte fallback has pieces of unknown length")
    return {
        "map": normalizer.get(2, b""),
        "prefix": bool(normalizer.get(3, 1)),
        "squeeze": bool(normalizer.get(4, 1)),
        "escape": bool(normalizer.get(5, 1)),
        "suffix": bool(trainer.get(24, 0)),
    }


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and model file."""
    return Codec(path)


def encode(docs: DataFrame, keep: list[str], path: str, text: Column | None = None) -> DataFrame:
    """``keep`` columns with piece ids, their spans in bytes of the text (end exclusive), and the ids decoded again.

    ``path``: the model file, at the same place on every machine.
    """
    return map_text(docs, keep, text_of() if text is None else text, lambda bodies: codec(path).encode(bodies), ENCODED)
