"""Stateless steps give the same rows on a stream of files."""

import json

import pytest
from pyspark.sql import functions as F

from pagesift.functions import urls
from pagesift.operators import extract, fetch, search, validate
from pagesift.operators.results import blacklist_filter
from pagesift.sources import files
from pagesift.operators.distinct import distinct_keep_first
from pagesift.streaming.results import first_results, follow, saved_changes, stream_results
from tests.conftest import SF
from workload import inputs


def run(stream, tmp_path):
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    return stream.sparkSession.read.parquet(out)


def test_extraction_on_a_stream(spark, tmp_path):
    folder = str(tmp_path / "pages")
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("status", (F.col("page_id") % 2 * 300 + 200).cast("int"))
    pages.repartition(5).write.parquet(folder)

    def steps(df):
        df = df.select(
            "url",
            F.col("html").alias("text"),
            "status",
            F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("binary").alias("body"),
        )
        df = fetch.classify_response(df).where(F.col("response") == "content")
        df = df.withColumn("text", fetch.decode_body(F.col("text"), F.col("body")))
        found = extract.extract_results(df, inputs.template(), ["url"], inputs.EXCLUDES)
        return found.select(
            urls.normalize(F.col("url")).alias("url"),
            urls.url_problem(F.col("url")).alias("problem"),
            F.to_json("results").alias("results"),
            fetch.outcome(F.lit(True), F.size("results") > 0).alias("outcome"),
        )

    expected = steps(pages).collect()
    found = run(steps(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(folder)), tmp_path).collect()
    assert sorted(found) == sorted(expected)
    assert len(found) == 125


def test_queries_and_validation_on_a_stream(spark, tmp_path):
    folder = str(tmp_path / "rows")
    rows = spark.range(100).select(
        F.when(F.col("id") % 2 == 0, "site:x q").otherwise("q").alias("query"),
        F.concat(F.lit("http://h/google"), F.when(F.col("id") % 3 == 0, "dork").otherwise("x"), "id").alias("url"),
    )
    rows.repartition(4).write.parquet(folder)

    def steps(df):
        kept = blacklist_filter(df.where(~search.has_site(F.col("query"))))
        matched = validate.validate_match(F.concat("url", F.lit(" not found")), F.lit("link"), inputs.template())
        return kept.select(urls.strip_text_fragment(F.col("url")).alias("url"), matched.alias("matched"))

    expected = steps(rows).collect()
    found = run(steps(spark.readStream.schema(rows.schema).parquet(folder)), tmp_path).collect()
    assert sorted(found) == sorted(expected)


def test_result_files_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    for i in range(3):
        (folder / f"results_{i}.json").write_text(json.dumps([{"query": f"q{i}", "urls": [f"u{i}", "u"]}]))
    (folder / "bad.json").write_text("{")
    (folder / "old.report.json").write_text("[]")
    found = run(stream_results(spark, str(folder), max_files=1), tmp_path)
    expected = files.read_results(spark, str(folder))
    columns = ["query", "url", "pos"]
    assert sorted(found.select(columns).collect()) == sorted(expected.select(columns).collect())
    assert found.count() == 6


def follow_rows(spark, tmp_path, rows, changes, per_batch):
    """The saved changes of a stream over files of ``rows``, and how many batches there were."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    assert follow(changes(stream), out, str(tmp_path / "state")).awaitTermination(300)
    return saved_changes(spark, out, "query", "url", "pos"), len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")])


def some_results(spark, n=4000):
    """Result rows of two thirds of which belong to one query, with repeats, ties and positions that get smaller and larger."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 > 0, "hot").otherwise(F.concat(F.lit("q"), i % 5)).alias("query"),
        F.concat(F.lit("é"), F.pmod(F.xxhash64(i), F.lit(700))).alias("url"),
        F.pmod(F.xxhash64(i, F.lit(1)), F.lit(900)).alias("pos"),
    )


@pytest.mark.parametrize("per_batch", [1, 7])
def test_first_results_in_any_number_of_batches(spark, tmp_path, per_batch):
    rows = some_results(spark).repartition(7, "pos").sortWithinPartitions(F.desc("pos"))
    saved, batches = follow_rows(spark, tmp_path, rows, lambda s: first_results(s, 12, salts=3), per_batch)
    assert batches == 7 // per_batch
    found = sorted(search.cap_results(saved, 12).collect())
    assert found == sorted(search.cap_results(rows, 12).collect())
    assert len(found) == 6 * 12
    # a group never saves more rows of a batch than it holds
    assert saved.count() <= 6 * 3 * 12 * batches


def test_first_positions_in_any_number_of_batches(spark, tmp_path):
    rows = some_results(spark, 1000).repartition(4)
    saved, batches = follow_rows(spark, tmp_path, rows, lambda s: distinct_keep_first(s, "query", "url"), 1)
    assert batches == 4
    assert sorted(distinct_keep_first(saved, "query", "url").collect()) == sorted(distinct_keep_first(rows, "query", "url").collect())


def test_followed_files_that_come_later(spark, tmp_path):
    folder, out, state = tmp_path / "results", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for i in range(4):
        (folder / f"r{i}.json").write_text(json.dumps([{"query": "q", "urls": [f"u{j}" for j in range(i, 9 - i)]}, {"query": f"q{i}", "urls": ["u"]}]))
        changes = first_results(blacklist_filter(stream_results(spark, str(folder))), 3)
        assert follow(changes, out, state).awaitTermination(120)
        kept = search.cap_results(saved_changes(spark, out, "query", "url", "pos"), 3)
        assert sorted(kept.collect()) == sorted(search.cap_results(files.read_results(spark, str(folder)), 3).collect())
    before = saved_changes(spark, out, "query", "url", "pos").count()
    assert follow(changes, out, state).awaitTermination(120)
    assert saved_changes(spark, out, "query", "url", "pos").count() == before


def test_bounds_of_followed_results(spark, tmp_path):
    stream = spark.readStream.schema("query STRING, url STRING, pos BIGINT").parquet(str(tmp_path))
    for bounds in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            first_results(stream, *bounds)
