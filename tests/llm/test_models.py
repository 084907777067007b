"""The two trained models: held-out accuracy, and results that don't depend on how rows are batched."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import byte_cnn, gbt_quality
from pagesift.llm.queries import REGISTRY
from tests.conftest import SF


def out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = REGISTRY["op10_byte_cnn"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.95


def test_quality(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = REGISTRY["op5_gbt_quality"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.95


def test_language_of_odd_documents(odd_docs, no_docs):
    net = byte_cnn.learn(odd_docs)
    rows = byte_cnn.identify(odd_docs, ["doc_id", "kept"], net).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(by_id[i] == ("und", 0.0) for i in (0, 1, 2, 3))
    assert all(by_id[i][0] == "en" for i in (4, 7, 9))
    assert by_id[10] == by_id[100]
    assert byte_cnn.learn(no_docs) is None
    assert {r.lang_pred for r in byte_cnn.identify(odd_docs, ["doc_id"], None).collect()} == {"und"}
    assert byte_cnn.identify(no_docs, ["doc_id"], net).collect() == []


def test_windows_cover_the_whole_text():
    rng = np.random.default_rng(1)
    windows = byte_cnn.windows_of([b"der die das und nicht " * 12, b"the of and to in that " * 12] * 20)[0]
    net = byte_cnn.train(windows, ["de"] * 0 + [("de", "en")[i // 2 % 2] for i in range(len(windows))])
    text = bytes(b"the of and to in that " * 5) + bytes(b"der die das und nicht " * 200)
    assert byte_cnn.classify(net, [text])["lang_pred"].to_pylist() == ["de"]
    texts = [text, b"the of", b""] + [bytes(rng.integers(97, 122, n, dtype=np.uint8)) for n in (1, 255, 256, 257, 3000)]
    together = byte_cnn.classify(net, texts)["score"].to_pylist()
    assert together == pytest.approx([byte_cnn.classify(net, [t])["score"].to_pylist()[0] for t in texts], abs=1e-5)


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, int(i > 8), None) for i in range(15)] + [(None, 1, 1), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, score int")
    trees = gbt_quality.learn(odd_docs, labels)
    rows = gbt_quality.quality(odd_docs, ["doc_id"], trees).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[0] == scores[1] and scores[10] == scores[100]
    assert gbt_quality.learn(odd_docs, labels.where("false")) is None
    assert gbt_quality.learn(no_docs, labels) is None
    assert {r.score for r in gbt_quality.quality(odd_docs, ["doc_id"], None).collect()} == {0.5}
    assert gbt_quality.quality(no_docs, ["doc_id"], trees).collect() == []


def test_trees_are_walked_as_they_are_grown():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(gbt_quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] < -0.5)).astype(float)
    trees = gbt_quality.train(x[:2000], y[:2000])
    got = gbt_quality.predict(trees, x[2000:])

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert got[:50] == pytest.approx([walk(r) for r in x[2000:2050]])
    assert ((got > 0.5) == y[2000:]).mean() > 0.95


def test_training_rows_are_bounded(spark):
    from pagesift.llm.common import drawn

    table = spark.range(50_000).select(F.col("id"))
    some = [r.id for r in drawn(table, "id", 100, ["id"]).collect()]
    assert len(some) == len(set(some)) == 100
    assert some == [r.id for r in drawn(table.repartition(7), "id", 100, ["id"]).collect()]


def plain_scores(net, window):
    """One window through the network by loops: look up, slide each filter over its own width, keep the largest, add up."""
    size = net.embedding.shape[1]
    filters = net.filters.reshape(byte_cnn._WIDEST, size, -1)
    active = []
    for f in range(filters.shape[2]):
        width = byte_cnn.WIDTHS[f // byte_cnn.FILTERS]
        best = max(
            sum(float(net.embedding[window[at + i], j]) * float(filters[i, j, f]) for i in range(width) for j in range(size))
            for at in range(byte_cnn.WINDOW - byte_cnn._WIDEST + 1)
        )
        active.append(max(0.0, best + float(net.bias[f])))
    logits = [sum(a * float(w) for a, w in zip(active, net.out[:, c])) + float(net.out_bias[c]) for c in range(len(net.langs))]
    e = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(e) for x in e]


def test_network_by_loops():
    """Convolution, pooling and softmax of single windows, and their mean over a text."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (256, 40, 500)]
    net = byte_cnn.train(byte_cnn.windows_of(texts)[0], ["a", "b", "c", "a"])
    windows, counts = byte_cnn.windows_of(texts)
    want = [plain_scores(net, w) for w in windows]
    assert byte_cnn.window_scores(net, windows) == pytest.approx(np.array(want), abs=1e-4)
    found = byte_cnn.classify(net, texts)
    last = [(256 * x + 244 * y) / 500 for x, y in zip(want[2], want[3])]
    assert found["score"].to_pylist() == pytest.approx([max(want[0]), max(want[1]), max(last)], abs=1e-4)
    assert found["lang_pred"].to_pylist() == [net.langs[int(np.argmax(s))] for s in (want[0], want[1], last)]


def test_gradients_by_differences():
    rng = np.random.default_rng(5)
    windows = rng.integers(97, 105, (6, byte_cnn.WINDOW)).astype(np.uint8)
    y, weight = np.array([0, 1, 2, 0, 1, 2]), np.array([1.0, 2.0, 0.5, 1.0, 1.5, 1.0])
    total = byte_cnn.FILTERS * len(byte_cnn.WIDTHS)
    mask = np.zeros((byte_cnn._WIDEST, byte_cnn.EMBEDDING, total))
    for i, width in enumerate(byte_cnn.WIDTHS):
        mask[:width, :, i * byte_cnn.FILTERS : (i + 1) * byte_cnn.FILTERS] = 1
    mask = mask.reshape(-1, total)
    p = [rng.normal(0, 0.5, s) for s in ((256, byte_cnn.EMBEDDING), mask.shape, total, (total, 3), 3)]
    p[1] *= mask

    def loss():
        net = byte_cnn.Network(("a", "b", "c"), *p)
        x = byte_cnn._patches(net.embedding, windows)
        top = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(*x.shape[:2], -1).max(axis=1)
        scores = byte_cnn._softmax(np.maximum(top + net.bias, 0) @ net.out + net.out_bias)
        return float((-np.log(scores[np.arange(6), y]) * weight).mean())

    found = byte_cnn.gradients(p, mask, windows, y, weight)
    for values, grads, allowed in zip(p, found, (None, mask, None, None, None)):
        places = [i for i in rng.permutation(values.size) if allowed is None or allowed.reshape(-1)[i]][:40]
        flat = values.reshape(-1)
        for i in places:
            own = flat[i]
            flat[i] = own + 1e-6
            above = loss()
            flat[i] = own - 1e-6
            below = loss()
            flat[i] = own
            assert grads.reshape(-1)[i] == pytest.approx((above - below) / 2e-6, abs=1e-5)


def plain_statistics(text):
    """FEATURES by counting characters and words one by one."""
    body = text.encode()
    out = []
    for members in gbt_quality._CLASSES.values():
        out.append(sum(b in members for b in body) / max(1, len(body)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", body)
    lines = [x for x in body.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    n, k = max(1, len(words)), max(1, len(lines))
    out += [math.log(1 + len(body)), math.log(1 + len(words)), sum(len(w) for w in words) / n, len(set(words)) / n]
    out.append(sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n)
    out.append(max([sum(v == w for v in words) for w in set(words)], default=0) / n)
    out += [len(words) / k, (len(lines) - len(set(lines))) / k, sum(len(x) < 20 for x in lines) / k, sum(x.endswith((b".", b"!", b"?")) for x in lines) / k]
    return out


def test_statistics_by_counting():
    texts = ["", " ", "\n\n", "One two. two\nTwo!\n\n# 12 | é🙂\x0b*", "a " * 50, "A.\nA.\nb?\r\n" * 3, "x" * 300 + "\n" + "y z " * 9]
    found = gbt_quality.statistics([t.encode() for t in texts])
    assert found == pytest.approx(np.array([plain_statistics(t) for t in texts]))
    assert found[0] == pytest.approx(gbt_quality.statistics([b""])[0])


def test_a_split_is_the_best_of_all():
    """The first tree's root takes the cut whose gain is largest among all features and all cuts, by trying each."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (400, len(gbt_quality.FEATURES))).astype(float)
    y = (x[:, 3] + rng.normal(0, 2, 400) > 6).astype(float)
    trees = gbt_quality.train(x, y)
    share = y.mean()
    g, h = share - y, np.full(400, share * (1 - share))

    def gain(f, cut):
        left = x[:, f] <= cut
        if min(h[left].sum(), h[~left].sum()) < gbt_quality.LEAST_HESSIAN:
            return 0
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + gbt_quality.SHRINK)
        return score(left) + score(~left) - score(left | ~left)

    best = max(gain(f, c) for f in range(x.shape[1]) for c in range(12))
    assert gain(trees.feature[0, 0], trees.threshold[0, 0]) == pytest.approx(best)
