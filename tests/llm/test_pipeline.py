"""The pipeline against plain versions of its stages, and its behaviour on odd tables."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagesift.llm import byte_cnn, repetition
from pagesift.session import materialize
from tests.conftest import SF
from tests.llm.test_duplicates import jaccard_shingles, roots, squeezed
from tests.llm.test_tokens import check_packing


def plain(rows, net):
    """(doc_id, text) that reach the last stage."""
    found = repetition.measure([(t or "").encode() for _, t in rows])
    kept = []
    for i, row in enumerate(rows):
        n, windows, covered, longest = (found[k][i].as_py() for k in ("n_words", "n_repeat_words", "covered_words", "longest_repeat"))
        if n >= 10 and windows * 100 <= 20 * n and covered <= repetition.MOST_COVERED * n and longest <= repetition.MOST_LONGEST:
            kept.append(row)
    langs = byte_cnn.classify(net, [t.encode() for _, t in kept])
    kept = [r for r, lang, clear in zip(kept, langs["lang_pred"].to_pylist(), langs["clear"].to_pylist()) if lang != "und" and clear >= corpus_pipeline.LEAST_CLEAR]
    first = {}
    for doc_id, text in kept:
        first[squeezed(text)] = min(doc_id, first.get(squeezed(text), doc_id))
    kept = [r for r in kept if first[squeezed(r[1])] == r[0]]
    sets = {doc_id: jaccard_shingles(text) for doc_id, text in kept}
    found = roots(sets, [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    return {i: [t] for i, t in kept if found[i] == i}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = materialize(corpus_pipeline.quality_rules(spark, docs, SF), "rules")
    net = byte_cnn.learn(rules)
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], net)
    check_packing(want, corpus_pipeline.run(spark, SF).collect())


def test_stages_on_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            own = Counter(map(tuple, docs.collect()))
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            assert not Counter(map(tuple, out.collect())) - own
        packed = corpus_pipeline.packing(spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert [r.doc_id for r in corpus_pipeline.exact_dedup(spark, odd_docs, SF).collect()].count(10) == 1
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, odd_docs, SF).collect()}.isdisjoint({12, 100})


def test_near_copies_of_real_documents(spark):
    """What the near-duplicate stage keeps, against brute-force Jaccard similarity."""
    docs = materialize(corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "exact")
    sets = {r.doc_id: jaccard_shingles(r.text) for r in docs.collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    kept = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()]
    assert pairs and sorted(kept) == sorted(set(roots(sets, pairs).values()))


def test_rows_not_ids_are_dropped(spark, tmp_path):
    """An id that stands on a near copy and on another text loses the first only; two near copies with one id are one; null ids come last."""
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:-1], "other"])
    rows = [(3, " ".join(words)), (7, near), (7, "an unrelated text " * 3), (None, near + " end"), (9, "b " + near[1:]), (9, "b " + near[1:])]
    rows += [(None, " ".join(words[::-1])), (None, " ".join(words[::-1]) + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = Counter(map(tuple, corpus_pipeline.simhash_near_dedup(spark, table, SF).collect()))
        assert kept[rows[0]] == kept[rows[2]] == 1 and sum(kept.values()) == 3
        assert sum(n for (i, _), n in kept.items() if i is None) == 1


def test_numbers_last(spark):
    """Rows of files get the same number whatever is read with them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.numbered(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]))
    first, again = (dict(map(tuple, rows.select("node", *more, "c0").drop(*more).collect())) for more in ([], ["c1"]))
    assert first == again and len(first) == docs.count()


def test_languages_without_labels(spark, odd_docs):
    """Lettered texts stay where nothing says what languages there are; with two languages, texts that neither claims can go."""
    docs = odd_docs.drop("lang").withColumn("lang", F.lit(None).cast("string")).select(*odd_docs.columns)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    net = byte_cnn.Network(("a", "b"), *[np.zeros(s, np.float32) for s in ((256, 4), (20, 32), 32, (32, 2), 2)])
    found = byte_cnn.classify(net, [b"abc", b""])
    assert found["clear"].to_pylist() == [0, 0] and found["score"].to_pylist() == [0.5, 0]
