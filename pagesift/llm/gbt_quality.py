"""A quality score from histogram gradient-boosted trees over statistics of the whole text.

Statistics are shares of byte classes, and measures of words and lines (``FEATURES``), taken in one pass. Trees are grown level by level from
histograms of gradients over at most ``BINS`` quantile bins per statistic, on the driver, from at most ``TRAIN_ROWS`` labelled rows:
those not held out, drawn by a hash of doc_id. A fitted model is three flat arrays, one entry per node of complete trees of equal depth; all trees of a
batch of documents are walked at once, one numpy step per level.

Null texts count as empty and get the score of their all-zero statistics. Without any labelled row every score is 0.5. Equal texts get equal
scores. Labels, language, source and id are no statistics. Columns of the input other than those named are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import drawn, is_held_out, map_text

#: labelled rows that the trees learn from, at most
TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_HESSIAN = 2.0
SHRINK = 1.0

_CLASSES = {
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#*$%&<>@/\\_=+~^`[]{}",
    "wide": bytes(range(0xC0, 0x100)),
}
_TABLE = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members)] = _i

FEATURES = (
    *[f"share_{c}" for c in _CLASSES],
    "log_bytes",
    "log_words",
    "word_bytes",
    "distinct_words",
    "same_as_last",
    "top_word",
    "line_words",
    "repeated_lines",
    "short_lines",
    "ended_lines",
)


def statistics(bodies: list[bytes]) -> np.ndarray:
    """FEATURES of each text, all 0 for an empty one."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    width = len(_CLASSES) + 1
    key = np.repeat(np.arange(len(bodies)) * width, sizes)
    key += _TABLE[np.frombuffer(b"".join(bodies), np.uint8)]
    shares = np.bincount(key, minlength=len(bodies) * width).reshape(-1, width)[:, : width - 1] / np.maximum(sizes, 1)[:, None]
    rest = []
    for body in bodies:
        words = body.split()
        lines = [x for x in body.split(b"\n") if x and not x.isspace()]
        n, k = max(1, len(words)), max(1, len(lines))
        counts = Counter(words)
        rest.append((
            np.log1p(len(body)),
            np.log1p(len(words)),
            sum(map(len, words)) / n,
            len(counts) / n,
            sum(map(eq, words, words[1:])) / n,
            max(counts.values(), default=0) / n,
            len(words) / k,
            1 - len(set(lines)) / k if lines else 0.0,
            sum(len(x) < 20 for x in lines) / k,
            sum(x[-1:] in b".!?" for x in lines) / k,
        ))
    return np.hstack([shares, np.array(rest, np.float64).reshape(len(bodies), -1)])


@dataclass(frozen=True)
class Trees:
    """Complete trees; node i has the children 2i + 1 and 2i + 2, right if the statistic is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float


def train(x: np.ndarray, y: np.ndarray) -> Trees | None:
    if not len(y):
        return None
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    n, d = x.shape
    inner = 2**DEPTH - 1
    feature = np.zeros((TREES, inner), np.int64)
    threshold = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, inner + 1))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    offset = np.arange(d) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (d * BINS) + offset + binned).reshape(-1)
            sums = [np.bincount(key, np.repeat(v, d), many * d * BINS).reshape(many, d, BINS) for v in (g, h)]
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(left_h < LEAST_HESSIAN) | (all_h - left_h < LEAST_HESSIAN)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            for j in range(many):
                if gain[j, f[j], b[j]] > 1e-9 and b[j] < len(cuts[f[j]]):
                    feature[t, first + j], threshold[t, first + j] = f[j], cuts[f[j]][b[j]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + SHRINK)
        margin += leaf[t, at]
    return Trees(feature, threshold, leaf, base)


def predict(trees: Trees | None, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of statistics."""
    if trees is None:
        return np.full(len(x), 0.5)
    inner = trees.feature.shape[1]
    rows, all_trees = np.arange(len(x))[:, None], np.arange(len(trees.leaf))[None]
    node = np.zeros((len(x), len(trees.leaf)), np.int64)
    for _ in range(inner.bit_length()):
        node = 2 * node + 1 + (x[rows, trees.feature[all_trees, node]] > trees.threshold[all_trees, node])
    return 1 / (1 + np.exp(-(trees.base + trees.leaf[all_trees, node - inner].sum(axis=1))))


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id", rows: int = TRAIN_ROWS
) -> Trees | None:
    """Trees from at most ``rows`` labelled rows that are not held out. Their ids are few by that bound, so they are broadcast."""
    usable = labels.where(~is_held_out(doc_id) & F.col(label).isNotNull())
    chosen = drawn(usable.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")), "id", rows, ["id", "label"])
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    seen = scored(own, ["id", "label"], lambda x: x).orderBy("id", "label", "made").limit(rows).collect()
    x = np.array([r["made"] for r in seen], np.float64).reshape(len(seen), len(FEATURES))
    return train(x, np.array([r["label"] for r in seen], np.float64))


def scored(docs: DataFrame, keep: list[str], made, text: str = "text") -> DataFrame:
    def compute(bodies):
        values = made(statistics(bodies))
        return {"made": pa.array(list(values), pa.list_(pa.float64()) if values.ndim > 1 else pa.float64())}

    kind = "array<double>" if made(np.zeros((1, len(FEATURES)))).ndim > 1 else "double"
    return map_text(docs, keep, text, compute, f"made {kind}")


def quality(docs: DataFrame, keep: list[str], trees: Trees | None, text: str = "text") -> DataFrame:
    """``keep`` columns with ``score``, the probability that the whole text has label 1."""
    return scored(docs, keep, lambda x: predict(trees, x), text).withColumnRenamed("made", "score")
