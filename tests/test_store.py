"""A bucketed store gives the responses that a join with all copies gives, without moving bodies; a URL filter loses nothing; counts come with the run."""

import uuid

import pytest
from pyspark.sql import functions as F

from pagesift.operators import fetch
from pagesift.plans.runs import extract_run, plaintext_run
from pagesift.session import shared_dir
from pagesift.sources import store
from tests.conftest import SF
from workload import inputs


def new_store(spark, responses, buckets=4, **options):
    name = f"store_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    return store.write_store(responses, name, path, buckets, **options), path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_request(spark):
    rows = [
        ("http://h/a?y=2&x=1", 200, 1, "old"), ("http://h/a?x=1&y=2", 200, 3, "new"), ("http://h/a?x=1&y=2#f", 500, None, "first"),
        ("http://h/b", 404, 2, "b"), ("http://h/b", 404, 2, "b"), (None, 200, 1, "nobody's"), ("", 200, 1, "empty"),
    ]
    schema = "url STRING, status INT, at INT, text STRING"
    responses = spark.createDataFrame(rows, schema).select("*", F.lit(None).cast("string").alias("error"), F.lit(None).cast("binary").alias("body"))
    kept, _ = new_store(spark, responses, order_by="at")
    asked = spark.createDataFrame([("http://h/a?x=1&y=2", "k"), ("http://h/b#x", "k"), ("http://h/b#x", "l"), ("http://h/c", "k"), (None, "n"), ("", "e")], "url STRING, key STRING")
    found = store.attach_stored(asked, kept).select("url", "key", "text", "stored_url").collect()
    assert sorted(found, key=str) == sorted(
        [
            ("http://h/a?x=1&y=2", "k", "new", "http://h/a?x=1&y=2"), ("http://h/b#x", "k", "b", "http://h/b"), ("http://h/b#x", "l", "b", "http://h/b"),
            ("http://h/c", "k", None, None), (None, "n", None, None), ("", "e", "empty", ""),
        ],
        key=str,
    )


def test_no_exchange_above_the_stored_bodies(spark, monkeypatch):
    kept, path = new_store(spark, inputs.responses(spark, SF), 8, order_by="fetched_at")
    again = store.open_store(spark, f"again_{uuid.uuid4().hex}", path, 8)
    pages = inputs.pages(spark, SF).select("url")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = []
        for table in (kept, again):
            attached = store.attach_stored(pages, table).select("url", "status", F.md5("text").alias("text"))
            results.append(sorted(attached.collect(), key=str))
            lines = plan_of(attached).splitlines()
            scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
            join = max(i for i, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
            depth = lines[scan].index("FileScan")
            above, at = [], depth
            for line in reversed(lines[join:scan]):  # the way from the scan up to the join
                start = len(line) - len(line.lstrip(" :+-*()0123456789"))
                if start < at:
                    above.append(line)
                    at = start
            assert above and not [line for line in above if "Exchange" in line or "AQEShuffleRead" in line]
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("bits", [2, 5, 10, 40])
def test_a_url_filter_loses_nothing(spark, bits):
    n = 40_000
    wanted = spark.range(n).select(F.concat(F.lit("http://h/"), F.col("id") * 2).alias("url"))
    wanted = wanted.union(spark.createDataFrame([(None,)], "url STRING"))
    size = n * bits // 8
    held, blocks, tests = fetch.url_filter(wanted, "url", n + 1, size + 100)
    assert held.agg(F.sum(F.length("bits"))).first()[0] <= size + 4096
    pages = spark.range(2 * n).select(F.concat(F.lit("http://h/"), "id").alias("url"), "id")
    kept = fetch.only_wanted(pages, wanted, max_bytes=size + 100, with_columns=())
    through = {r.id % 2: r["count"] for r in kept.groupBy(F.col("id") % 2).count().withColumnsRenamed({"(id % 2)": "id"}).collect()}
    assert through[0] == n
    chance = (1 - 2.718281828 ** (-tests / min(bits, fetch.MOST_BITS))) ** tests
    assert through.get(1, 0) < n * (1.3 * chance + 0.003)
    assert kept.columns == pages.columns


def test_a_list_too_long_for_a_filter(spark):
    wanted = spark.range(1000).select(F.col("id").cast("string").alias("url"), F.lit("k").alias("keys"))
    assert fetch.url_filter(wanted, "url", 1000, 100) is None
    pages = spark.range(5000).select(F.col("id").cast("string").alias("url"))
    assert fetch.only_wanted(pages, wanted, 100).count() == 5000
    behind = fetch.only_wanted(pages, wanted, 1000, with_columns=("keys",))
    assert 1000 <= behind.count() < 5000
    assert behind.where("keys IS NOT NULL").isEmpty()


def test_counts_come_with_the_run(spark):
    rows = inputs.results(spark, SF)
    run = extract_run(rows, inputs.responses(spark, SF), inputs.template(), inputs.EXCLUDES, order_by="fetched_at")
    expected = sorted(fetch.status_counts(run.outcomes()).collect())
    assert sorted(run.status_counts().collect()) == expected and len(expected) > 2
    assert "Scan parquet" not in plan_of(run.status_counts())


def test_counts_of_an_empty_run(spark):
    texts = spark.createDataFrame([], "file STRING, text STRING")
    run = plaintext_run(texts, inputs.responses(spark, SF).limit(0), inputs.template())
    assert run.status_counts().collect() == fetch.status_counts(run.outcomes()).collect() == []
