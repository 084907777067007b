"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with a smallest period q (words q apart are identical) and ``max(LEAST_WORDS, 2 * q)`` words or more that no
neighbouring word extends. Each of its words occurs in it at least twice. So a word that occurs once within a segment lies in no run of that
segment: it splits the segment. Parts are split again until no segment holds such a word; parts below ``LEAST_WORDS`` are dropped.
Occurrences are never counted anew: a word is alone in [start, end) if the one like it before lies before ``start`` and the next one at ``end`` or later. The
first rounds look at all words of a chunk of documents at once; what is left is searched from both ends in growing steps, so a split costs no more than its smaller part.

What survives is scanned lag by lag. A run of period q is a stretch of q equal pairs (i, i + q) or more, so it holds a pair at a multiple of
half of q (each pair for small lags), and there whole blocks of words must agree, by hashes of 1, 2, 4 ... words. The pairs that do are extended
exactly, in steps that grow. A pair within a known run whose period divides the lag is passed over: it belongs to that run. Lags rise, so a stretch is
first met with its smallest period. So a segment of n words takes about n log n comparisons, not n * n.

Null texts have no words and no runs. Every row gives one row; equal rows give equal rows. Columns other than ``keep`` and the text are not read. An empty table gives
an empty result. Words are bytes between blanks, whole texts are read.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagesift.llm.common import map_text

LEAST_WORDS = 12
#: lags from which on pairs are looked at in steps only
_STEP_FROM = 8
#: longest blocks of words that are compared by one hash, as a power of two
_LEVELS = 6
#: a further round over all words is worth it if it drops one of so many of them
_SHRINK = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word occurred before and occurs next; -1 and the number of words if nowhere."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _stretches(kept: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the stretches of true with ``least`` places or more."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], kept.view(np.int8), [0]))))
    found = edges.reshape(-1, 2)
    return found[found[:, 1] - found[:, 0] >= least]


def _alone_near_an_end(before: np.ndarray, after: np.ndarray, start: int, end: int) -> np.ndarray:
    """The first words, from either end of a segment, that are alone in it; empty if none is."""
    low, high, step = start, end, 64
    while low < high:
        for a, b in ((low, min(low + step, high)), (max(high - step, low), high)):
            alone = np.flatnonzero((before[a:b] < start) & (after[a:b] >= end))
            if len(alone):
                return alone + a
        low, high, step = low + step, high - step, 2 * step
    return np.empty(0, np.int64)


def segments(words: np.ndarray, starts: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """The segments of all documents (that begin at ``starts``) in which every word occurs twice or more."""
    n = len(words)
    before, after = neighbours(words)
    borders = np.unique(np.append(starts, n))
    found = np.stack((borders[:-1], borders[1:]), axis=1)
    found = found[found[:, 1] - found[:, 0] >= least]
    while len(found):
        sizes = found[:, 1] - found[:, 0]
        low, high = np.repeat(found[:, 0], sizes), np.repeat(found[:, 1], sizes)
        at = np.arange(sizes.sum()) + np.repeat(found[:, 0] - np.cumsum(sizes) + sizes, sizes)
        held = (before[at] >= low) | (after[at] < high)
        # a place between segments keeps neighbours apart
        kept = np.zeros(len(at) + len(found), bool)
        shift = np.repeat(np.arange(len(found)), sizes)
        kept[np.arange(len(at)) + shift] = held
        parts = _stretches(kept, least)
        owner = np.searchsorted(np.cumsum(sizes + 1), parts[:, 0], side="right")
        parts = parts + (found[owner, 0] - (np.cumsum(sizes + 1) - sizes - 1)[owner])[:, None]
        left = int((parts[:, 1] - parts[:, 0]).sum())
        found = parts
        if left * _SHRINK > (_SHRINK - 1) * len(at):
            break
    todo, out = [tuple(x) for x in found.tolist()], []
    while todo:
        start, end = todo.pop()
        alone = _alone_near_an_end(before, after, start, end)
        if not len(alone):
            out.append((start, end))
            continue
        edges = [start - 1, *alone.tolist(), end]
        todo += [(a + 1, b) for a, b in zip(edges, edges[1:]) if b - a - 1 >= least]
    return sorted(out)


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two arrays have in common from their start on."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differs = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, step = at + step, 2 * step
    return n


def lag_scan(words: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, by start, then period."""
    n = len(words)
    blocks = [words.astype(np.uint64) * _MIX]
    for level in range(1, _LEVELS + 1):
        half = 1 << (level - 1)
        last = blocks[-1]
        if len(last) <= half:
            break
        mixed = (last[:-half] ^ (last[half:] >> np.uint64(31))) * _MIX + last[half:]
        blocks.append(mixed ^ (mixed >> np.uint64(29)))
    covered_to, covered_by = np.zeros(n, np.int64), np.ones(n, np.int64)  # the run that reaches furthest over each word
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, n // 2 + 1):
        need = max(lag, least - lag)
        step = 1 if lag < _STEP_FROM else (need + 1) // 2
        # of ``need`` pairs in a row one is a multiple of the step with the rest of the block behind it
        level = min((need - step + 1).bit_length() - 1, len(blocks) - 1)
        block = blocks[level]
        if len(block) <= lag:
            continue
        at = np.flatnonzero(block[: len(block) - lag : step] == block[lag::step]) * step
        at = at[(covered_to[at] <= at + lag) | (lag % covered_by[at] != 0)]
        done = -1
        for i in at.tolist():
            if i < done:
                continue
            behind = _reach(words[i:], words[i + lag :])
            ahead = _reach(words[:i][::-1], words[lag : lag + i][::-1])
            start, pairs = i - ahead, ahead + behind
            done = i + behind
            if pairs >= need and (start, pairs + lag) not in found:
                found[start, pairs + lag] = lag
                end = start + pairs + lag
                further = covered_to[start:end] < end
                covered_to[start:end][further] = end
                covered_by[start:end][further] = lag
    return sorted((start, length, period) for (start, length), period in found.items())


def runs_of(docs: list[np.ndarray], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs of each document; words are numbers, and equal numbers in two documents don't meet."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not sizes.sum():
        return out
    words = np.concatenate(docs)
    owner = np.repeat(np.arange(len(docs)), sizes)
    apart = owner * (int(words.max()) + 1) + words
    for start, end in segments(apart, starts[sizes > 0], least):
        doc = int(owner[start])
        at = start - int(starts[doc])
        out[doc] += [(at + s, length, period) for s, length, period in lag_scan(words[start:end], least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run is collapsed to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def digest(runs: list[tuple[int, int, int]]) -> str:
    return sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()


def measure(bodies: list[bytes], least: int = LEAST_WORDS) -> dict[str, pa.Array]:
    """Runs and collapsed text of each text."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    split = [body.split() for body in bodies]
    docs = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in split]
    found = runs_of(docs, least)
    collapsed = [
        b" ".join(words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()) if runs else b" ".join(words)
        for words, runs in zip(split, found)
    ]
    return {
        "n_words": pa.array([len(words) for words in split], pa.int64()),
        "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], _RUNS),
        "runs_sha256": pa.array(map(digest, found), pa.string()),
        "collapsed": pa.array(collapsed, pa.binary()),
    }


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``keep`` columns with n_words, runs (by start, then period), runs_sha256 and collapsed, the words that stay joined by one space."""
    schema = f"n_words long, runs {RUNS}, runs_sha256 string, collapsed binary"
    return map_text(docs, keep, text, lambda bodies: measure(bodies, least), schema)
