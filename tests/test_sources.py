import json

import pytest
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions.patterns import PatternError
from pagesift.sinks import writers
from pagesift.sources import files, social, tables, templates
from pagesift.sources.templates import TemplateError


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_read_queries(spark, tmp_path):
    path = write(tmp_path, "q.txt", b" a b \r\n\r\n c\rA b\na b\n\x85\xe9\xa0\n")
    rows = files.read_queries(spark, path).orderBy("pos").collect()
    assert [(r.query, r.pos) for r in rows] == [("a b", 0), ("c", 2), ("A b", 3), ("é", 5)]


def test_literal_queries_are_not_stripped(spark):
    rows = files.literal_queries(spark, [" x ", "y", " x "]).orderBy("pos").collect()
    assert [r.query for r in rows] == [" x ", "y"]


def test_read_excludes(spark, tmp_path):
    assert files.read_excludes(spark, write(tmp_path, "e.txt", "a+\nb\n")) == ["a+", "b"]
    with pytest.raises(PatternError):
        files.read_excludes(spark, write(tmp_path, "bad.txt", "a+\n(b\n"))


@pytest.fixture
def result_folder(tmp_path):
    good = [
        {"query": "q1", "user_agent": "ua", "proxy": "", "urls": ["u2", "u1"]},
        {"query": "q2"},
        {"query": "q1", "urls": ["u3"], "extra": 1},
    ]
    write(tmp_path, "good.json", "  " + json.dumps(good))
    write(tmp_path, "object.json", json.dumps(good[0]))
    write(tmp_path, "element.json", json.dumps([good[0], "text"]))
    write(tmp_path, "text.json", "not json")
    write(tmp_path, "trailing.json", json.dumps(good) + " trailing")
    write(tmp_path, "two.json", json.dumps(good) * 2)
    write(tmp_path, "single.json", json.dumps(good).replace('"', "'"))
    write(tmp_path, "null.json", json.dumps([good[0], None]))
    write(tmp_path, "cut.json", '[{"query": "q1", "urls": ["u9"]}')
    write(tmp_path, "empty.json", "")
    write(tmp_path, "old.report.json", json.dumps(good))
    (tmp_path / "deeper").mkdir()
    write(tmp_path / "deeper", "good.json", json.dumps(good))
    return tmp_path


def test_read_results(spark, result_folder):
    rows = files.read_results(spark, str(result_folder)).orderBy("pos").collect()
    assert [(r.query, r.url) for r in rows] == [("q1", "u2"), ("q1", "u1"), ("q1", "u3")]
    assert len({r.pos for r in rows}) == 3
    assert {r.file.rsplit("/", 1)[1] for r in rows} == {"good.json"}


def test_rejected_results(spark, result_folder):
    rejected = files.rejected_results(spark, str(result_folder)).collect()
    assert {r.file.rsplit("/", 1)[1] for r in rejected} == {
        "object.json", "element.json", "text.json", "cut.json", "trailing.json", "two.json", "single.json", "null.json",
    }


def test_an_explicit_report_file_is_read(spark, result_folder):
    path = str(result_folder / "old.report.json")
    assert files.read_results(spark, path, skip_reports=False).count() == 3


def test_read_plaintext(spark, tmp_path):
    write(tmp_path, "a.txt", b"\n one\r\ntwo\xe9 ")
    rows = files.read_plaintext(spark, str(tmp_path)).collect()
    assert [r.text for r in rows] == ["one\ntwoé"]


def test_read_template(spark, tmp_path):
    source = {
        "a": {"extract": "x(y)", "validate_browser_wait": 2, "validate_headers": {"A": "1", "a": "2"}},
        "b": {"extract": "z", "validate": "q"},
    }
    template = templates.read_template(spark, write(tmp_path, "t.json", json.dumps(source)))
    assert [(e.key, e.ord, e.validate_browser_wait) for e in template] == [("a", 0, 2.0), ("b", 1, 0.0)]
    rows = templates.template_table(spark, template).orderBy("ord").collect()
    assert rows[0].validate_headers == {"a": "2"}
    assert rows[1].validate == "q"


@pytest.mark.parametrize(
    "source",
    ["{", "[]", '{"a": {"validate": "x"}}', '{"a": {"extract": "x", "other": 1}}', '{"a": "x"}'],
)
def test_bad_templates_are_rejected(source):
    with pytest.raises(TemplateError):
        templates.parse_template(source)


def test_template_patterns_are_checked(spark, tmp_path):
    for bad in ("(a)(b)", "(a"):
        with pytest.raises(PatternError):
            templates.read_template(spark, write(tmp_path, "t.json", json.dumps({"k": {"extract": bad}})))


def test_template_for_stage():
    template = templates.entries_of(
        {"a": {"extract": "x"}, "b": {"extract": "", "validate": "v"}, "c": {"extract": "y", "validate": "v"}}
    )
    stages = (schemas.EXTRACTION, schemas.VALIDATION)
    kept = [[e.key for e in templates.template_for_stage(template, stage)] for stage in stages]
    assert kept == [["a", "c"], ["c"]]


def test_social_template_and_queries():
    assert [e.key for e in social.social_template()] == [
        "telegram", "discord", "youtube", "twitter", "facebook", "instagram", "tiktok", "linkedin-company", "linkedin-user",
    ]
    assert len(social.SOCIAL_QUERIES) == 8


def test_read_responses_fills_missing_columns(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([("u", 200, "t")], "url STRING, status INT, text STRING").write.parquet(path)
    row = tables.read_responses(spark, path).first()
    assert row.asDict() == {"url": "u", "final_url": None, "status": 200, "body": None, "text": "t", "error": None}


def test_small_tables_are_spread_and_large_ones_are_not(spark, tmp_path):
    small, large = str(tmp_path / "s"), str(tmp_path / "l")
    spark.range(100).coalesce(1).write.parquet(small)
    spark.range(100).repartition(20).write.parquet(large)
    cores = spark.sparkContext.defaultParallelism
    assert tables.read_pages(spark, small).rdd.getNumPartitions() == cores
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))
    try:
        plan = tables.read_pages(spark, large)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Repartition" not in plan


def test_one_per_url_takes_the_latest(spark):
    rows = [("u", 1, "old"), ("u", 3, "new"), ("u", 3, "new"), ("u", None, "undated"), ("v", None, "only")]
    df = spark.createDataFrame(rows, "url STRING, at INT, text STRING")
    latest = tables.one_per_url(df, tables.copy_order("at", "text"))
    assert {(r.url, r.text) for r in latest.collect()} == {("u", "new"), ("v", "only")}


def test_one_per_url_is_repeatable_without_an_order(spark):
    df = spark.createDataFrame([("u", f"t{i}") for i in range(20)], "url STRING, text STRING")
    first = tables.one_per_url(df).first().text
    assert tables.one_per_url(df.repartition(7).orderBy(F.desc("text"))).first().text == first


def test_searches_saved_per_site_are_read_under_their_names(spark, tmp_path):
    for site in ("one", "two"):
        rows = [("q", f"http://{site}/{i}", i) for i in range(5)]
        df = spark.createDataFrame(rows, "query STRING, url STRING, pos BIGINT").repartition(3)
        writers.write_results(df, str(tmp_path / f"{site}.json"), chunk=2)
    for read in (files.read_results, files.read_result_lines):
        found = read(spark, f"{tmp_path}/*").orderBy("file", "pos").collect()
        assert [(r.file.rsplit("/", 1)[1], r.url) for r in found] == [
            (f"{site}.json", f"http://{site}/{i}") for site in ("one", "two") for i in range(5)
        ]
    assert files.rejected_results(spark, f"{tmp_path}/*").count() == 0


def test_a_report_is_read_in_parts(spark, tmp_path):
    """The lines of a folder's part files are one text, in order, whatever blocks they are read in."""
    lines = spark.range(3000).selectExpr("concat('line é ', lpad(id, 5, '0')) AS value")
    lines.repartitionByRange(4, "value").sortWithinPartitions("value").write.text(str(tmp_path / "r"))
    whole = [f"line é {i:05d}" for i in range(3000)]
    for size in ("128m", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.read_report(spark, str(tmp_path / "r"), "UTF-8").orderBy("file", "part").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {r.file.rsplit("/", 1)[1] for r in rows} == {"r"} and [r.text for r in rows] == whole
        assert (len({r.part.block for r in rows}) > 1) == (size == "1000")


def test_text_parts_are_decoded(spark, tmp_path):
    write(tmp_path, "a.txt", b"one\r\ntwo\xe9\rthree")
    assert [r.text for r in files.read_text_parts(spark, str(tmp_path)).orderBy("part").collect()] == ["one", "twoé", "three"]
    with pytest.raises(ValueError):
        files.read_text_parts(spark, str(tmp_path), "UTF-16")
