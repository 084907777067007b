"""Quality rules by suffix arrays: long repeats inside a document, next to counts of words, symbols, lines and repeated windows.

Every chunk of documents gets one suffix array over its words. It is built by prefix doubling: suffixes are ranked by their
first word, then by their first 2, 4, 8 ... words, and only those still tied are sorted again. Words are numbered per
document, so that a suffix never ties with one of another document. The longest common prefix of neighbours in the array is
read off the ranks of the doublings. A suffix repeats as far as the deeper of its two neighbours' prefixes, which is the
value of the innermost LCP interval that holds it; where the suffix one word before doesn't already carry that repeat, it is
maximal, and the union of the maximal spans is what the document repeats.

Null texts are empty: no words, so ``base_failed``. Every row gives one row; equal rows give equal rows. Columns of the input other
than ``keep`` and the text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import map_text

#: words of the windows that the base rule counts
WINDOW = 5
#: words from which on a repeat counts for the verdict
LEAST_REPEAT = 10
#: a document is rejected if a larger part of its words lies in repeats ...
MOST_COVERED = 0.2
#: ... or if one repeat has more words
MOST_LONGEST = 100
#: base rule: words at least, and percent of words in repeated windows at most
LEAST_WORDS, MOST_WINDOW_PERCENT = 10, 20

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, spans array<struct<start:int,end:int>>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def suffix_levels(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until none are tied; equal rank: equal words so far.

    A rank is the place in the suffix array at which the suffix's group of ties begins.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.empty(n, bool)
    first[:1] = True
    sorted_words = words[order]
    np.not_equal(sorted_words[1:], sorted_words[:-1], out=first[1:])
    begins = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begins
    alone = first & np.append(first[1:], True)
    tied = order[~alone]
    levels = [rank.astype(np.int32)]
    step = 1
    while len(tied):
        ahead = tied + step
        inside = ahead < n
        key = rank[tied] * (n + 1)
        key[inside] += rank[ahead[inside]] + 1
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        first = np.empty(len(key), bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        group = rank[tied]
        new_group = np.empty(len(key), bool)
        new_group[0] = True
        np.not_equal(group[1:], group[:-1], out=new_group[1:])
        places = np.arange(len(key))
        group_at = np.maximum.accumulate(np.where(new_group, places, 0))
        first_at = np.maximum.accumulate(np.where(first, places, 0))
        rank[tied] = group + (first_at - group_at)
        levels.append(rank.astype(np.int32))
        tied = tied[~(first & np.append(first[1:], True))]
        step *= 2
    return levels


def repeat_lengths(words: np.ndarray) -> np.ndarray:
    """For each position, the most words from there on that occur elsewhere too (overlaps included)."""
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    levels = suffix_levels(words)
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    shared = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    a, b = array[shared], array[shared + 1]
    common = np.zeros(len(shared), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.maximum(x, y) < n
        level = levels[j]
        same = np.zeros(len(x), bool)
        same[inside] = level[x[inside]] == level[y[inside]]
        common += same << j
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a maximal repeat of ``least`` words or more."""
    n = len(longest)
    start = np.flatnonzero((longest >= least) & (np.append(0, longest[:-1]) != longest + 1))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + longest[start], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(bodies: list[bytes], least: int = LEAST_REPEAT) -> dict[str, pa.Array]:
    """MEASURES of each text."""
    docs = [body.split() for body in bodies]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    starts, total = ends - sizes, int(sizes.sum())
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = np.empty(total, np.int64)
    for doc, at, n in zip(docs, starts, sizes):
        words[at : at + n] = np.fromiter(map(numbers.__getitem__, doc), np.int64, n)
    owner = np.repeat(np.arange(len(docs)), sizes)
    longest = repeat_lengths(owner * len(numbers) + words)

    def by_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[ends] - sums[starts]

    in_repeat = covered(longest, least)
    edges = np.diff(np.concatenate(([0], in_repeat.astype(np.int8), [0])))
    # a span ends with its document at the latest
    last = np.zeros(total + 1, bool)
    last[starts[sizes > 0]] = True
    opens = np.flatnonzero((edges == 1) | (last & np.append(in_repeat, False)))
    closes = np.flatnonzero((edges == -1) | (last & np.append(False, in_repeat)))
    span_doc = owner[opens]
    most = np.zeros(len(docs), np.int64)
    np.maximum.at(most, owner, np.where(longest >= least, longest, 0))
    offsets = np.append(0, np.cumsum(np.bincount(span_doc, minlength=len(docs)))).astype(np.int32)
    spans = pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.StructArray.from_arrays(
            [pa.array((opens - starts[span_doc]).astype(np.int32)), pa.array((closes - starts[span_doc]).astype(np.int32))],
            names=["start", "end"],
        ),
    ).cast(_SPANS)
    lines = [[x for x in body.split(b"\n") if not x.isspace() and x] for body in bodies]
    return {
        "n_words": pa.array(sizes),
        "word_chars": pa.array([len(b.translate(None, _NOT_COUNTED)) for b in bodies], pa.int64()),
        "n_symbols": pa.array([len(b) - len(b.translate(None, _SYMBOLS)) for b in bodies], pa.int64()),
        "n_dup_lines": pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
        "n_repeat_words": pa.array(by_doc(covered(longest, WINDOW))),
        "covered_words": pa.array(by_doc(in_repeat)),
        "longest_repeat": pa.array(most),
        "spans": spans,
    }


def repetition_rules(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    least_repeat: int = LEAST_REPEAT,
    most_covered: float = MOST_COVERED,
    most_longest: int = MOST_LONGEST,
) -> DataFrame:
    """``keep`` columns with MEASURES, ``base_failed`` and ``kept``; ``spans`` are the repeated word ranges, end exclusive."""
    found = map_text(docs, keep, text, lambda bodies: measure(bodies, least_repeat), MEASURES)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_WINDOW_PERCENT * F.col("n_words"))
    fine = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
