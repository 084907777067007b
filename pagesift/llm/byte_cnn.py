"""Language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes, the last one filled up with zeros. Each byte is embedded, filters of several
widths slide over the window, each filter's maximum is kept, and a softmax layer turns the maxima into a probability per
language. A text's probabilities are the mean over all its windows, weighted by their bytes: every byte of the whole
text counts. The network is trained in numpy on the driver, on one window from each of at most ``TRAIN_ROWS`` labelled
rows (drawn by a hash of doc_id), so training is bounded whatever the size of the table.

``clear`` is the part of a text's bytes that lies in windows which some language claims clearly; a text in two languages may be all clear. With one learned
language every lettered text is.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if there was nothing to learn from. Ties go to the
language that sorts first. Equal texts get equal results. Columns of the input other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import drawn, is_held_out, map_text, text_of

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBEDDING = 4
#: labelled rows that the network learns from, at most
TRAIN_ROWS = 6_000
EPOCHS = 12
BATCH = 64
NONE = "und"
#: a window is clear if its most probable language is so far from chance, on the way to certainty
CLEAR = 0.25

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(range(256)).lower()
_WIDEST = max(WIDTHS)
_PLACES = WINDOW - _WIDEST + 1


@dataclass(frozen=True)
class Network:
    langs: tuple[str, ...]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, one below the other, and how many each text has."""
    counts = np.array([max(1, -(-len(b) // WINDOW)) for b in bodies], np.int64)
    flat = b"".join(b.ljust(n * WINDOW, b"\0") for b, n in zip(bodies, counts.tolist()))
    return np.frombuffer(flat.translate(_FOLD), np.uint8).reshape(-1, WINDOW), counts


def _patches(embedding: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The widest filter's view at each place: (windows, places, widest * embedding)."""
    seen = embedding[windows]
    size = embedding.shape[1]
    b, _, item = seen.strides
    view = np.lib.stride_tricks.as_strided(seen, (len(windows), _PLACES, _WIDEST * size), (b, size * item, item))
    return np.ascontiguousarray(view)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def window_scores(net: Network, windows: np.ndarray, most: int = 64) -> np.ndarray:
    """Probabilities of each language, per window."""
    parts = [np.zeros((0, len(net.langs)), np.float32)]
    for at in range(0, len(windows), most):
        x = _patches(net.embedding, windows[at : at + most])
        n, places, k = x.shape
        top = (x.reshape(-1, k) @ net.filters).reshape(n, places, -1).max(axis=1)
        parts.append(_softmax(np.maximum(top + net.bias, 0) @ net.out + net.out_bias))
    return np.concatenate(parts)


def gradients(p: list[np.ndarray], mask: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted cross-entropy, by embedding, filters, bias, output weights and output bias; ``mask`` holds the narrow filters' widths."""
    x = _patches(p[0], windows)
    n, places, k = x.shape
    total = p[1].shape[1]
    made = (x.reshape(-1, k) @ p[1]).reshape(n, places, total)
    where = made.argmax(axis=1)
    top = np.take_along_axis(made, where[:, None, :], 1)[:, 0] + p[2]
    active = np.maximum(top, 0)
    g = _softmax(active @ p[3] + p[4])
    g[np.arange(n), y] -= 1
    g *= weight[:, None] / n
    back = (g @ p[3].T) * (top > 0)
    chosen = np.take_along_axis(x, where[:, :, None], 1)
    d_patch = (back[:, :, None] * p[1].T[None]).reshape(n, total, _WIDEST, EMBEDDING)
    seen = np.take_along_axis(windows[:, None, :], where[:, :, None] + np.arange(_WIDEST), 2)
    d_embedding = np.zeros_like(p[0])
    np.add.at(d_embedding, seen.reshape(-1), d_patch.reshape(-1, EMBEDDING))
    return [d_embedding, np.einsum("bfk,bf->kf", chosen, back) * mask, back.sum(0), active.T @ g, g.sum(0)]


def train(windows: np.ndarray, labels: list[str], seed: int = 7) -> Network | None:
    """Fit by Adam on the cross-entropy, each language weighing alike; None without labels."""
    if not labels:
        return None
    langs = tuple(sorted(set(labels)))
    y = np.array([langs.index(x) for x in labels])
    weight = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs))))[y].astype(np.float32)
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    mask = np.zeros((_WIDEST, EMBEDDING, total), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(-1, total)
    p = [
        rng.normal(0, 0.5, (256, EMBEDDING)),
        rng.normal(0, 0.3, mask.shape) * mask,
        np.zeros(total),
        rng.normal(0, 0.2, (total, len(langs))),
        np.zeros(len(langs)),
    ]
    p = [x.astype(np.float32) for x in p]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            grads = gradients(p, mask, windows[pick], y[pick], weight[pick])
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for v, m, s, d in zip(p, first, second, grads):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= rate * m / (np.sqrt(s) + 1e-8)
    return Network(langs, *p)


def classify(net: Network | None, bodies: list[bytes]) -> dict[str, pa.Array]:
    if net is None:
        return {"lang_pred": pa.array([NONE] * len(bodies), pa.string()), **{c: pa.array([0.0] * len(bodies)) for c in ("score", "clear")}}
    windows, counts = windows_of(bodies)
    starts = np.cumsum(counts) - counts
    sizes = np.full(len(windows), WINDOW)
    sizes[starts + counts - 1] = [max(1, len(b) - (n - 1) * WINDOW) for b, n in zip(bodies, counts.tolist())]
    scores = window_scores(net, windows).astype(np.float64)
    total = np.add.reduceat(sizes, starts)
    mean = np.add.reduceat(scores * sizes[:, None], starts, axis=0) / total[:, None]
    chance = 1 / len(net.langs)
    claimed = scores.max(axis=1) >= chance + CLEAR * (1 - chance) - 1e-6
    clear = np.add.reduceat(claimed * sizes, starts) / total
    lettered = np.array([_LETTER.search(b.decode("utf-8", "replace")) is not None for b in bodies])
    best = mean.argmax(axis=1)
    score = np.where(lettered, np.clip(mean.max(axis=1), 0, 1), 0.0)
    return {"lang_pred": pa.array([net.langs[i] if ok else NONE for i, ok in zip(best, lettered)]), "score": pa.array(score), "clear": pa.array(np.where(lettered, clear, 0.0))}


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Network | None:
    """A network from at most ``rows`` labelled rows that are not held out; one window of each, at a place drawn by a hash."""
    body = text_of(text).cast("binary")
    spare = F.greatest(F.length(body) - WINDOW + 1, F.lit(1))
    place = F.pmod(F.xxhash64(doc_id, F.lit("place")), spare).cast("int") + 1
    usable = docs.where(~is_held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    windows = usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.substring(body, place, F.lit(WINDOW)).alias("window"))
    seen = drawn(windows, "id", rows, ["id", "lang", "window"]).collect()
    return train(windows_of([bytes(r["window"]) for r in seen])[0] if seen else np.zeros((0, WINDOW), np.uint8), [r["lang"] for r in seen])


def identify(docs: DataFrame, keep: list[str], net: Network | None, text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``clear`` of the whole text."""
    return map_text(docs, keep, text, lambda bodies: classify(net, bodies), "lang_pred string, score double, clear double")
