"""Packing and separator scan against the tokenizer library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagesift.llm import histogram_packing, separator_scan
from pagesift.llm.byte_bpe import byte_bpe
from pagesift.llm.queries import END_OF_DOCUMENT, REGISTRY, SPECIALS
from tests.conftest import SF

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ORDINARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ORDINARY.encode_special_tokens = True


def ids_of(text, library=LIBRARY):
    return library.encode(text or "", add_special_tokens=False).ids


def test_special_names():
    """A special token's name is its id where the library makes it that, and ordinary text where that id ends documents."""
    for text in ("<|endoftext|> x", "a<|endoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext|", "|><|endoftext|>é"):
        assert byte_bpe(RANKS, public_tokenizers.PATTERN, SPECIALS).ids(text.encode()).tolist() == ids_of(text)
        assert byte_bpe(RANKS, public_tokenizers.PATTERN).ids(text.encode()).tolist() == ids_of(text, ORDINARY)
    assert len(ids_of("<|endoftext|> x")) == 2 or END_OF_DOCUMENT in ids_of("<|endoftext|> x")


def check_packing(docs, rows):
    """Every id of every document lies in one piece, every sequence is filled from 0 without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, found in by_doc.items():
        texts = docs[doc_id]
        own = [*ids_of(texts[0]), 0]
        assert sum(r.length for r in found) == len(own) * len(texts) and {r.doc_tokens for r in found} == {len(own)}
        assert Counter(r.start for r in found) == {s: len(texts) for s in range(0, len(own), 1024)}
        for r in found:
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    assert set(by_doc) == set(docs)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return by_sequence


def test_packing_query(spark):
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = check_packing(docs, REGISTRY["op9_histogram_packing"](spark, SF).collect())
    used = sum(length for places in found.values() for _, length in places)
    assert used / (1024 * len(found)) > 0.98


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    docs = defaultdict(list)
    for r in odd_docs.collect():
        docs[r.doc_id].append(r.text)
    cut = histogram_packing.pieces(odd_docs, ["doc_id"], RANKS, public_tokenizers.PATTERN, specials=SPECIALS)
    placed = histogram_packing.place(spark, cut, ["doc_id", "start", "ids_crc32", "doc_tokens"])
    rows = placed.collect()
    found = check_packing(docs, rows)
    whole = {r.sequence_id: r for r in histogram_packing.sequences(cut, placed).collect()}
    assert set(whole) == set(found)
    for r in rows:
        ids = np.frombuffer(whole[r.sequence_id].ids, "<u4")
        n = whole[r.sequence_id].length
        assert len(ids) == (n if n & (n - 1) == 0 else 1024)
        assert zlib.crc32(ids[r.offset : r.offset + r.length].tobytes()) == r.ids_crc32
    none = histogram_packing.pieces(no_docs, ["doc_id"], RANKS, public_tokenizers.PATTERN)
    assert histogram_packing.place(spark, none, ["doc_id"]).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_patterns_hold_the_histogram(histogram):
    found = histogram_packing.patterns(histogram, 32)
    assert all(sum(p) <= 32 and n > 0 for p, n in found)
    held = Counter()
    for pattern, n in found:
        for length in pattern:
            held[length] += n
    assert held == histogram
    assert len(found) <= 4 * 32
    seen = defaultdict(list)
    for length, low, high, _, _ in histogram_packing.ranges(found):
        seen[length].append((low, high))
    for length, spans in seen.items():
        assert [s for s, _ in sorted(spans)] + [histogram[length]] == [0] + [e for _, e in sorted(spans)]


def test_scan_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = REGISTRY["op6_separator_scan"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len(ids_of(t, ORDINARY))) for i, t in docs.items())


def test_scan_of_odd_documents(spark, odd_docs, no_docs):
    folder = separator_scan.flat_dir(spark)
    places = separator_scan.write_flat(odd_docs, RANKS, public_tokenizers.PATTERN, END_OF_DOCUMENT, folder)
    want = Counter((r.doc_id, len(ids_of(r.text, ORDINARY))) for r in odd_docs.collect())
    for block in (1, 5, 1 << 20):
        counts = separator_scan.token_counts(spark, folder, END_OF_DOCUMENT, block=block if block > 1 else 7)
        rows = places.join(counts, ["file", "ordinal"]).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    empty = separator_scan.flat_dir(spark)
    assert separator_scan.write_flat(no_docs, RANKS, public_tokenizers.PATTERN, END_OF_DOCUMENT, empty).collect() == []
    assert separator_scan.token_counts(spark, empty, END_OF_DOCUMENT).collect() == []


@pytest.mark.parametrize("block", [1, 2, 3, 10])
def test_boundaries_are_stitched(spark, tmp_path, block):
    """Documents longer than blocks, separators at block ends, an unfinished last document, a file without any separator."""
    files = {"a": [1, 2, 0, 0, 3, 4, 5, 6, 7, 0, 8], "b": [5] * 9, "c": [0], "d": [1, 1, 1, 0], "e": []}
    want = set()
    for name, tokens in files.items():
        (tmp_path / f"{name}.tokens").write_bytes(np.array(tokens, "<u2").tobytes())
        n, ordinal = 0, 0
        for t in tokens:
            if t:
                n += 1
            else:
                want.add((f"{name}.tokens", ordinal, n, True))
                n, ordinal = 0, ordinal + 1
        if n:
            want.add((f"{name}.tokens", ordinal, n, False))
    assert {tuple(r) for r in separator_scan.token_counts(spark, str(tmp_path), 0, block=block).collect()} == want
