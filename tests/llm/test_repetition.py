"""Measures against counting by hand, repeats against a quadratic search."""

import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesift.llm.repetition import LEAST_REPEAT, MOST_COVERED, MOST_LONGEST, measure, repeat_lengths, repetition_rules
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_lengths(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def slow_spans(words, least):
    inside = set()
    for i, n in enumerate(slow_lengths(words)):
        if n >= least:
            inside.update(range(i, i + n))
    spans = []
    for i in sorted(inside):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    return inside, spans


def by_hand(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4), st.integers(1, 6))
def test_repeats(docs, least):
    found = measure([" ".join(map(str, d)).encode() for d in docs], least)
    for i, d in enumerate(docs):
        assert repeat_lengths(np.array(d, np.int64)).tolist() == slow_lengths(d)
        inside, spans = slow_spans(d, least)
        assert found["covered_words"][i].as_py() == len(inside)
        assert [[s["start"], s["end"]] for s in found["spans"][i].as_py()] == spans
        longest = max(slow_lengths(d), default=0)
        assert found["longest_repeat"][i].as_py() == (longest if longest >= least else 0)


def test_table(odd_docs, no_docs):
    rows = repetition_rules(odd_docs, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = TEXTS[r.doc_id if r.doc_id < 100 else 10]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        fine = r.covered_words <= MOST_COVERED * r.n_words and r.longest_repeat <= MOST_LONGEST
        assert r.kept == (not r.base_failed and fine)
    assert repetition_rules(no_docs, ["doc_id"]).collect() == []


def test_one_long_repeat_is_rejected(spark):
    once = [f"w{i}" for i in range(3000)]
    texts = [(1, " ".join(once)), (2, " ".join(once + once[: MOST_LONGEST + 1])), (3, " ".join(once + once[: LEAST_REPEAT + 1]))]
    rows = repetition_rules(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in rows} == {1: (False, True), 2: (False, False), 3: (False, True)}
