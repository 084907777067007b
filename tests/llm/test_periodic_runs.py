"""Runs against a search of all lags, the query against the contract word by word."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesift.llm.periodic_runs import lag_scan, measure, periodic_runs, runs_of, segments
from pagesift.llm.queries import REGISTRY
from tests.conftest import SF
from tests.llm.conftest import SCHEMA

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_runs(words, least=12):
    """(start, length, period) by every lag and every stretch."""
    n, smallest = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                smallest.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in smallest.items())


@st.composite
def documents(draw):
    words = draw(st.lists(st.integers(0, draw(st.integers(0, 12))), max_size=60))
    for _ in range(draw(st.integers(0, 2))):
        if words:
            a = draw(st.integers(0, len(words) - 1))
            words += words[a : a + draw(st.integers(1, 20))] * draw(st.integers(1, 4))
    return words


@settings(max_examples=400, deadline=None)
@given(st.lists(documents(), min_size=1, max_size=4), st.sampled_from([12, 12, 4]))
def test_runs(docs, least):
    assert runs_of([np.array(d, np.int64) for d in docs], least) == [slow_runs(d, least) for d in docs]


@settings(max_examples=200, deadline=None)
@given(documents())
def test_splitting_loses_no_run_and_is_stable(words):
    """In every segment each word occurs twice, and scanning the whole document finds the same."""
    array = np.array(words, np.int64)
    if not words:
        return
    found = segments(array, np.array([0]))
    for start, end in found:
        assert min(Counter(words[start:end]).values()) >= 2
    within = sorted((start + s, n, q) for start, end in found for s, n, q in lag_scan(array[start:end]))
    assert within == sorted(lag_scan(array))


def test_deep_splits_and_long_runs():
    """A split per level from both ends, one word a hundred thousand times, a long period: no quadratic work."""
    n = 3_000
    nested = [x for i in range(n) for x in (2 * i, 2 * i + 1)] + [2 * n] * 20 + [x for i in reversed(range(1, n)) for x in (2 * i, 2 * i - 1)]
    assert (6000, 20, 1) in runs_of([np.array(nested)])[0]
    assert runs_of([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]
    assert runs_of([np.tile(np.arange(1000), 50)]) == [[(0, 50_000, 1000)]]


def expected(doc_id, text):
    words = WORD.findall((text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {}
    runs = slow_runs([number.setdefault(w, len(number)) for w in words])
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *longest, sha256(lines.encode()).hexdigest(), sha256(collapsed).hexdigest()


FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 12000").collect()
    rows = {r.doc_id: tuple(r[f] for f in FIELDS) for r in REGISTRY["op11_periodic_runs"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r[1] > 0 for r in rows.values()) > len(rows) / 20
    for d in docs:
        assert rows[d.doc_id] == expected(d.doc_id, d.text)


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and blank texts, copies, repeated rows, clashing names, loops in short texts."""
    texts = [None, "", " \n", "a", "a b", "x " * 30, "é ü \x0b " * 20, "p q r\t" * 9 + "s"]
    rows = [(i, texts[i % len(texts)], *[None] * 8) for i in range(160)] + [(3, "x", *[None] * 8)] * 2
    rows.append((None, "y " * 40, *[None] * 8))
    at = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(at + "/documents.parquet")
    found = Counter(tuple(r[f] for f in FIELDS) for r in REGISTRY["op11_periodic_runs"](spark, at).collect())
    want = Counter(expected(i, t) for i, t, *_ in rows if i is not None)
    null = [r for r in found if r[0] is None]
    assert null == [(None, 1, 0, 40, 1, 40_000, *expected(-1, "y " * 40)[6:])]
    assert found - Counter(null) == want


def test_empty_table(spark, no_docs):
    assert periodic_runs(no_docs, ["doc_id"]).collect() == []
    assert measure([])["runs"].to_pylist() == []
