"""What the physical plans must and must not contain."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from pagesift.operators import extract, fetch, search, validate
from tests.conftest import SF
from workload import inputs
from workload.queries import REGISTRY


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    small = SF.replace("0.01", "0.001")
    return {name: plan(query(spark, small)) for name, query in REGISTRY.items()}


def test_no_python_worker_and_no_cross_join(plans):
    for name, text in plans.items():
        assert not re.search(r"Python|Pandas|CartesianProduct|NestedLoop", text), name


def test_matches_are_found_in_one_scan_without_a_shuffle_of_their_own(spark):
    text = plan(extract.extract_matches(inputs.page_texts(spark, SF), inputs.template(), ["url"]))
    assert text.count("FileScan") == 1
    # the small test table is spread over the cores once, before the work
    assert text.count("Exchange") == text.count("RoundRobinPartitioning") == 1


def test_scan_reads_only_what_is_needed(spark):
    text = plan(extract.extract_matches(inputs.page_texts(spark, SF), inputs.template(), ["url"]))
    assert "ReadSchema: struct<url:string,html:string>" in text


def test_excludes_and_lower_case_are_computed_once(spark):
    text = plan(extract.extract_results(inputs.page_texts(spark, SF), inputs.template(), ["url"], inputs.EXCLUDES))
    assert text.count("regexp_replace") == len(inputs.EXCLUDES)
    assert text.count("lower(text") == 1


def test_a_filter_on_results_does_not_repeat_the_patterns(spark):
    found = extract.extract_results(inputs.page_texts(spark, SF), inputs.template(), ["url"])
    filtered = plan(found.where(F.size("results") > 0))
    assert filtered.count("regexp_extract_all") == len(inputs.template())


def _exchanged(text: str) -> list[str]:
    """Columns below each exchange, as the plan prints them."""
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


def test_any_number_of_queries_is_one_scan(spark, tmp_path):
    table = str(tmp_path / "pages")
    inputs.pages(spark, SF).write.parquet(table)
    queries = [f'intext:"word{i}" OR intitle:"w{i}" -site:s{i}.com' for i in range(1000)]
    assert plan(search.search_pages(spark.read.parquet(table), queries)).count("FileScan") == 1


@pytest.mark.parametrize(("max_bytes", "joins"), [(1 << 20, "url"), (3000, "hash"), (100, "block"), (20, None)])
def test_wanted_pages_are_chosen_by_what_fits(spark, max_bytes, joins):
    """URLs, then hashes of URLs, then a Bloom filter, then all pages; the outcome is the same."""
    pages = inputs.pages(spark, SF).select("url", F.lit(200).alias("status"), "html")
    wanted = pages.select("url").limit(300)
    keyed = pages.withColumnRenamed("url", "request")
    chosen = fetch.only_wanted(keyed, wanted.withColumnRenamed("url", "request"), max_bytes, "request")
    found = re.search(r"BroadcastHashJoin \[(\w+)#", plan(chosen))
    assert (found and found.group(1)) == joins
    assert chosen.count() == 250


def test_copies_are_chosen_without_what_they_hold(spark):
    """No sort and no shuffle of results or bodies before the one join that needs them."""
    done = inputs.pages(spark, SF).select("url", F.lit("f").alias("file"))
    text = plan(extract.extract_pages(done, inputs.responses(spark, SF), inputs.template(), order_by="fetched_at"))
    assert not [line for line in text.splitlines() if "Aggregate" in line and re.search(r"results#|body#|text#", line)]


@pytest.mark.parametrize("max_broadcast", [0, fetch.BROADCAST_BYTES])
def test_page_bodies_are_not_shuffled(spark, tmp_path, max_broadcast):
    """In both stages, whether the wanted URLs are broadcast or not."""
    table = str(tmp_path / "responses")
    inputs.responses(spark, SF).repartition(20).write.parquet(table)
    stored = spark.read.parquet(table)
    wanted = stored.select("url", F.lit("f").alias("file"))
    stage_one = extract.extract_pages(wanted, stored, inputs.template(), max_broadcast=max_broadcast)
    done = stored.select("url", F.create_map(F.lit("link"), F.array("url")).alias("results"))
    stage_two = validate.validate_urls(done, stored, inputs.template(), max_broadcast=max_broadcast)
    for stage in (stage_one, stage_two):
        exchanged = _exchanged(plan(stage))
        assert exchanged
        for below in exchanged:
            assert not re.search(r"\b(text|body|html)#", below), below


def test_template_is_broadcast(spark):
    values = spark.read.parquet(f"{SF}/pages.parquet").select(F.substring("html", 1, 4).alias("key"), "url")
    assert "BroadcastHashJoin" in plan(validate.template_semi_join(values, inputs.template()))


def test_recency_reaches_the_scan(plans):
    assert "GreaterThanOrEqual(ts" in plans["recency_filter"]


def test_no_machine_local_cut_of_lineage():
    for path in (Path(entry_module.__file__).parent / "pagesift").rglob("*.py"):
        source = path.read_text()
        assert "localCheckpoint" not in source, path
        # one Arrow-batched function, the automaton of many required texts; no row-at-a-time one
        batched = source.count("pandas_udf") if path.name == "patterns.py" else 0
        assert ".toPandas(" not in source and source.lower().replace("stand", "").count("udf") == batched <= 1, path
