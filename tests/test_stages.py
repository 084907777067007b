"""Both stages and their reports, on hand-made rows."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagesift import schemas, session
from pagesift.functions import urls
from pagesift.functions.patterns import PatternError
from pagesift.operators import extract, fetch, parts, report, skew, validate
from pagesift.plans.runs import extract_run, plaintext_run, search_run
from pagesift.sinks import writers
from pagesift.sources import files, tables
from pagesift.sources.social import SOCIAL_QUERIES, social_template
from pagesift.sources.templates import entries_of

RESPONSES = schemas.RESPONSES

TEMPLATE = entries_of(
    {
        "num": {"extract": r"n(\d+)", "extract_prepend": "v:", "extract_append": "!", "validate": "gone", "validate_cookies": {"A": "1", "b": "2"}},
        "word": {"extract": "w[a-z]+"},
        "also": {"extract": r"m?n(\d+)", "extract_prepend": "v:", "extract_append": "!", "validate": "moved", "validate_browser": True,
                 "validate_headers": {"X": "1", "Cookie": "no"}},
    }
)


def responses(spark, *rows):
    """(url, status, text) rows; bytes become the body."""
    full = [
        (u, u, s, t if isinstance(t, bytes) else None, None if isinstance(t, bytes) else t, None) for u, s, t in rows
    ]
    return spark.createDataFrame(full, RESPONSES)


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "url STRING, text STRING")


def test_extract_results(spark):
    df = texts(spark, ("a", "n2 n10 n2 N1 wx WA wb"), ("b", "nothing"), ("c", None))
    rows = {r.url: r.results for r in extract.extract_results(df, TEMPLATE[:2], ["url"]).collect()}
    assert rows["a"] == {"num": ["v:1!", "v:10!", "v:2!"], "word": ["WA", "wb", "wx"]}
    assert rows["b"] == rows["c"] == {}


def test_matches_keep_order_and_repeats(spark):
    df = texts(spark, ("a", "n2 n1 n2 wx"))
    rows = extract.extract_matches(df, TEMPLATE[:2], ["url"]).orderBy("ord", "pos").collect()
    assert [(r.key, r.pos, r.value) for r in rows] == [("num", 0, "2"), ("num", 1, "1"), ("num", 2, "2"), ("word", 0, "wx")]


def test_optional_group_without_a_match_is_empty(spark):
    template = entries_of({"k": {"extract": "a(b)?"}})
    assert extract.extract_results(texts(spark, ("u", "ab a")), template, ["url"]).first().results == {"k": ["", "b"]}


def test_excludes_run_in_sequence_and_before_extraction(spark):
    df = texts(spark, ("u", "n1 <x>n2</x> n3\n<x>n4\n</x>"))
    rows = extract.extract_results(df, TEMPLATE[:1], ["url"], excludes=["<x>.*?</x>", "n1 "]).first()
    # the second element spans a line end, which a dot does not cross
    assert rows.results == {"num": ["v:3!", "v:4!"]}


def test_extraction_does_not_depend_on_partitions(spark):
    df = texts(spark, *[(f"u{i}", f"n{i} n{i % 3} w{'ab'[i % 2]}") for i in range(40)])
    found = [sorted(map(str, extract.extract_results(df.repartition(n), TEMPLATE, ["url"]).collect())) for n in (1, 7)]
    assert found[0] == found[1]


@pytest.mark.parametrize(
    ("status", "error", "usable"),
    [(200, None, True), (299, None, True), (401, None, True), (403, None, True), (404, None, True),
     (300, None, False), (500, None, False), (None, None, False), (200, "timeout", False)],
)
def test_classify(spark, status, error, usable):
    df = spark.createDataFrame([("u", status, error)], "url STRING, status INT, error STRING")
    assert fetch.classify_response(df).first().response == ("content" if usable else "error")


def test_decode_body(spark):
    df = spark.createDataFrame([("t", b"x"), (None, "é".encode()), (None, None)], "text STRING, body BINARY")
    decoded = fetch.decode_body(F.col("text"), F.col("body"))
    assert [r[0] for r in df.select(decoded).collect()] == ["t", "Ã©", ""]
    own = fetch.decode_body(F.col("text"), F.col("body"), "UTF-8")
    assert [r[0] for r in df.select(own).collect()] == ["t", "é", ""]


@pytest.mark.parametrize("max_broadcast", [0, fetch.BROADCAST_BYTES])
def test_extract_pages(spark, max_broadcast):
    inputs = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f"), ("c", "f"), ("d", "f")], "url STRING, file STRING")
    pages = responses(spark, ("a", 200, "n1"), ("b", 404, b"none"), ("c", 500, "n2"), ("other", 200, "n3"))
    rows = extract.extract_pages(inputs, pages, TEMPLATE[:1], max_broadcast=max_broadcast).collect()
    found = {r.url: (r.outcome, r.results) for r in rows}
    assert len(rows) == 4
    assert found == {"a": ("success", {"num": ["v:1!"]}), "b": ("no_match", {}), "c": ("error", {}), "d": ("error", {})}


def test_redirected(spark):
    df = spark.createDataFrame([("http://a", "http://a"), ("http://a?", "http://b")], "url STRING, final_url STRING")
    assert [r[0] for r in df.select(urls.redirected(F.col("url"), F.col("final_url"))).collect()] == [False, True]


def test_forms_of_one_request_share_a_response(spark):
    forms = ["http://h/a%20b?x=a%20b&y=%7E#1", "http://h/a b?y=~&x=a+b#2"]
    rows = spark.createDataFrame([("q", forms[0], 0, "f"), ("q", forms[1], 1, "g")], schemas.RESULTS)
    pages = responses(spark, (forms[0], 200, "n1"))
    done = extract.extract_pages(rows, pages, TEMPLATE[:1]).collect()
    assert [r.outcome for r in done] == ["success", "success"]
    run = extract_run(rows, pages, TEMPLATE[:1])
    assert [(r.url, r.outcome) for r in run.extraction.collect()] == [(min(forms), "success")]
    assert {(r.url, r.file) for r in run.files.collect()} == {(min(forms), "f"), (min(forms), "g")}


def test_bad_patterns_stop_a_run(spark):
    texts = spark.createDataFrame([("f", "a")], "file STRING, text STRING")
    for bad in ("[[:alpha:]]+", "(a)(b)"):
        with pytest.raises(PatternError):
            plaintext_run(texts, responses(spark), entries_of({"k": {"extract": bad}}))


def test_stage_tables_are_deleted(spark):
    with session.stage_tables(spark):
        kept = session.materialize(spark.range(3), "short")
        path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert Path(path).exists()
    assert not Path(path).exists()


def test_a_text_given_twice_is_one_page_of_its_report(spark):
    texts = spark.createDataFrame([("f", "n1"), ("f", "n1"), ("g", "n2")], "file STRING, text STRING")
    run = plaintext_run(texts, responses(spark), TEMPLATE[:1])
    lines = [r.line for r in run.report().orderBy(*report.LINE_ORDER).collect()]
    assert [x["file"] for x in json.loads("\n".join(lines))["full"]] == ["f", "g"]


def extraction(spark, rows):
    return spark.createDataFrame(rows, "url STRING, outcome STRING, results MAP<STRING, ARRAY<STRING>>")


def test_semi_join_and_validation_input(spark):
    done = extraction(spark, [("p", "success", {"num": ["v1", "v2"], "word": ["w"], "old": ["x"]}), ("q", "success", {"also": ["v1"]})])
    sources = spark.createDataFrame([("p", "f"), ("p", "g"), ("q", "h")], "url STRING, file STRING")
    expected = {(u, "num", f) for u in ("v1", "v2") for f in "fg"} | {("v1", "also", "h")}
    for salt_rows in (1, skew.SALT_ROWS):
        rows = validate.validation_input(done, TEMPLATE, sources, salt_rows).collect()
        assert {(r.url, r.key, r.file) for r in rows} == expected
        assert len(rows) == len(expected)
    by_file = report.page_files(done, sources)
    assert {tuple(r) for r in validate.validation_input(by_file, TEMPLATE).select("url", "key", "file").collect()} == expected


def test_group_by_url(spark):
    rows = [("u", "num", "f"), ("u", "also", "g"), ("u", "num", "f"), ("v", "num", "f")]
    inputs = spark.createDataFrame(rows, schemas.INPUTS)
    for salt_rows in (1, skew.SALT_ROWS):
        last = validate.group_by_url(inputs, TEMPLATE, salt_rows=salt_rows).collect()
        assert {tuple(r) for r in last} == {("u", "also", "f"), ("u", "also", "g"), ("v", "num", "f")}
    every = validate.group_by_url(inputs, TEMPLATE, per_key=True).collect()
    assert {tuple(r) for r in every} == set(rows)


@pytest.mark.parametrize("max_broadcast", [0, fetch.BROADCAST_BYTES])
def test_validate_urls(spark, max_broadcast):
    done = extraction(spark, [("p", "success", {"num": ["u1", "u2", "u3", "u4"], "word": ["u9"]}), ("q", "success", {"also": ["u2", "u5"]})])
    fetched = responses(spark, ("u1", 200, "it is GONE"), ("u2", 404, "gone"), ("u3", 500, "gone"), ("u5", 200, b"moved"), ("u9", 200, "gone"))
    rows = validate.validate_urls(done, fetched, TEMPLATE, max_broadcast=max_broadcast).collect()
    assert {(r.url, r.key, r.outcome) for r in rows} == {
        ("u1", "num", "success"), ("u2", "also", "no_match"), ("u3", "num", "error"), ("u4", "num", "error"), ("u5", "also", "success"),
    }
    both = validate.validate_urls(done, fetched, TEMPLATE, per_key=True, max_broadcast=max_broadcast).collect()
    assert {(r.url, r.key, r.outcome) for r in both if r.url == "u2"} == {("u2", "num", "success"), ("u2", "also", "no_match")}


def test_validate_match(spark):
    df = spark.createDataFrame([("gone", "num"), ("moved", "num"), ("Moved", "also"), ("gone", "word"), (None, "num")], "t STRING, k STRING")
    assert [r[0] for r in df.select(validate.validate_match(F.col("t"), F.col("k"), TEMPLATE)).collect()] == [True, False, True, False, None]


def test_fetch_plan(spark):
    inputs = spark.createDataFrame([("http://H.x/1", "num", "f"), ("http://H.x/1", "num", "g"), ("http://y/", "also", "f"), ("http://z/", "", "f")], schemas.INPUTS)
    rows = {r.url: r for r in fetch.fetch_plan(inputs, TEMPLATE).collect()}
    assert len(rows) == 3
    assert rows["http://H.x/1"].host == "h.x"
    assert rows["http://H.x/1"].cookies == {"a": "1", "b": "2"}
    assert rows["http://H.x/1"].cookie_header == "a=1; b=2"
    assert (rows["http://y/"].browser, rows["http://y/"].headers) == (True, {"x": "1"})
    assert (rows["http://z/"].browser, rows["http://z/"].browser_wait) == (False, 0.0)


def test_needs_browser(spark):
    assert fetch.needs_browser(TEMPLATE)
    assert not fetch.needs_browser(TEMPLATE[:2])


def test_outcomes_cover_all_inputs(spark):
    done = extraction(spark, [("p", "success", {"num": ["v"]}), ("q", "no_match", {}), ("r", "error", {})])
    outcomes = fetch.stage_outcomes(done)
    assert {(r.outcome, r.n) for r in fetch.status_counts(outcomes).collect()} == {("success", 1), ("no_match", 1), ("error", 1)}
    assert fetch.has_outcome(outcomes, "extraction", "error")
    assert not fetch.has_outcome(outcomes, "validation", "error")


@pytest.mark.parametrize("salt_rows", [1, 50, skew.SALT_ROWS])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_equals_a_plain_join(spark, salt_rows, how):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    many = spark.range(600).select(key.alias("k"), F.col("id").cast("string").alias("file"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5)], "k STRING, x INT")
    salted = skew.join_hot(many, few, "k", "file", how, salt_rows).select("k", "file", "x")
    plain = many.join(few, "k", how).select("k", "file", "x")
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_only_large_keys_are_hot(spark, monkeypatch):
    df = spark.range(100).select(F.when(F.col("id") < 60, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"))
    assert [(r.k, r.salts) for r in skew.hot_keys(df, "k", 25).collect()] == [("hot", 3)]
    assert skew.hot_keys(df, "k").count() == 0
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    assert [r.k for r in skew.hot_keys(df, "k", 1).collect()] == ["hot", "k0"]


# --- end to end -----------------------------------------------------------------------------------


def read_parts(path):
    """The document of a report directory: its parts in order."""
    parts = sorted(p for p in Path(path).iterdir() if p.name.startswith("part-"))
    return "".join(p.read_text() for p in parts)


def read_file_reports(spark, path):
    names = {r.report: (r.report_name, r.file) for r in spark.read.parquet(f"{path}/names").collect()}
    return {names[f.name.removeprefix("report=")]: read_parts(f) for f in Path(path).glob("reports/report=*")}


@pytest.fixture(scope="module")
def social_run(spark):
    page = '<a href="https://t.me/does_not_exist"> https://t.me/exists https://discord.com/invite/exists'
    results = spark.createDataFrame(
        [("q", "https://example.com/about", 0, "f/one.json"), ("q", "https://example.com/about", 0, "f/two.json"),
         ("q", "https://down.example.com/", 1, "f/two.json"), ("q", "https://plain.example.com/", 2, "f/three.json"),
         ("q", "https://down.example.com/3", 2, "f/three.json")],
        schemas.RESULTS,
    )
    fetched = responses(
        spark,
        ("https://example.com/about", 200, page),
        ("https://plain.example.com/", 200, "nothing"),
        ("https://t.me/does_not_exist", 200, '<meta property="og:title" content="Telegram: Contact @x">'),
        ("https://t.me/exists", 200, "hello"),
        ("https://discord.com/invite/exists", 503, ""),
    )
    return extract_run(results, fetched, social_template())


FULL = [
    {
        "url": "https://example.com/about",
        "results": {"telegram": ["https://t.me/does_not_exist", "https://t.me/exists"], "discord": ["https://discord.com/invite/exists"]},
    }
]


def test_report_document(social_run, tmp_path):
    path = str(tmp_path / "report.json")
    assert social_run.save(path, started_at="2023-12-23 03:30:10", ended_at="2023-12-23 04:20:00")
    expected = {
        "started_at": "2023-12-23 03:30:10",
        "ended_at": "2023-12-23 04:20:00",
        "summary": {
            "validated": ["https://t.me/does_not_exist"],
            "extracted": ["https://discord.com/invite/exists", "https://t.me/does_not_exist", "https://t.me/exists"],
        },
        "failed": {"validation": ["https://discord.com/invite/exists"], "extraction": ["https://down.example.com/", "https://down.example.com/3"]},
        "full": FULL,
    }
    assert read_parts(path) == json.dumps(expected, indent=4, ensure_ascii=False) + "\n"


def test_file_reports(spark, social_run, tmp_path):
    path = tmp_path / "files"
    assert social_run.save(str(tmp_path / "report.json"), str(path))
    written = {name: json.loads(text) for name, text in read_file_reports(spark, path).items()}
    assert set(written) == {("f/one.report.json", "f/one.json"), ("f/two.report.json", "f/two.json")}
    one, two = (written[name] for name in sorted(written))
    assert one["full"] == two["full"] == FULL
    assert one["summary"]["validated"] == two["summary"]["validated"] == ["https://t.me/does_not_exist"]
    assert one["failed"] == {"validation": ["https://discord.com/invite/exists"], "extraction": []}
    assert two["failed"]["extraction"] == ["https://down.example.com/"]


def test_parts_of_file_reports_make_up_the_whole(social_run):
    overall = {(r.section, r.value) for r in report.report_items(social_run.extraction, social_run.validation).collect()}
    by_file = report.page_files(social_run.extraction, social_run.files)
    value_files = validate.validation_input(by_file, social_run.template)
    parts = {(r.section, r.value) for r in report.file_items(by_file, social_run.validation, value_files).collect()}
    assert overall - parts == {("failed_extraction", "https://down.example.com/3")}
    assert parts <= overall
    salted = report.file_items(by_file, social_run.validation, value_files, salt_rows=1)
    assert {(r.section, r.value) for r in salted.collect()} == parts


def test_summary_is_the_union_of_full(social_run):
    full = report.full_results(social_run.extraction).collect()
    values = {v for r in full for vs in r.results.values() for v in vs}
    assert {r.value for r in report.summary_extracted(social_run.extraction).collect()} == values


def test_a_long_report_is_written_in_many_parts(spark, tmp_path):
    values = [f"value {i:05d} \"quoted\" \\ é \x01 \n" for i in range(3000)]
    done = extraction(spark, [(f"p{i}", "success", {"num": values[i * 30 : i * 30 + 30]}) for i in range(100)])
    lines = report.build_report(done, spark.createDataFrame([], "url STRING, key STRING, outcome STRING"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert writers.write_report(lines, fetch.stage_outcomes(done), str(tmp_path / "r"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("part-")]) > 3
    document = json.loads(read_parts(tmp_path / "r"))
    assert document["summary"] == {"validated": [], "extracted": sorted(values)}
    assert sorted(e["url"] for e in document["full"]) == sorted(f"p{i}" for i in range(100))


def test_no_report_without_a_success(spark, tmp_path):
    done = extraction(spark, [("p", "error", {})])
    lines = report.build_report(done, spark.createDataFrame([], "url STRING, key STRING, outcome STRING"))
    assert not writers.write_report(lines, fetch.stage_outcomes(done), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()


@pytest.fixture(scope="module")
def plain_run(spark):
    df = spark.createDataFrame([("d.x/b.txt", "n1 wz n2"), ("d.x/A", "n2"), ("d.x/none.txt", "-")], "file STRING, text STRING")
    return plaintext_run(df, responses(spark, ("v:1!", 200, "gone"), ("v:2!", 500, "")), TEMPLATE[:2])


def test_plaintext_report(spark, plain_run, tmp_path):
    assert plain_run.save(str(tmp_path / "r"), str(tmp_path / "files"), "s", "e")
    expected = {
        "started_at": "s",
        "ended_at": "e",
        "summary": {"validated": ["v:1!"], "extracted": ["v:1!", "v:2!", "wz"]},
        "failed": {"validation": ["v:2!"]},
        "full": [
            {"file": "d.x/A", "results": {"num": ["v:2!"]}},
            {"file": "d.x/b.txt", "results": {"num": ["v:1!", "v:2!"], "word": ["wz"]}},
        ],
    }
    assert read_parts(tmp_path / "r") == json.dumps(expected, indent=4) + "\n"
    written = read_file_reports(spark, tmp_path / "files")
    own = {
        "started_at": "s",
        "ended_at": "e",
        "summary": {"validated": [], "extracted": ["v:2!"]},
        "failed": {"validation": ["v:2!"]},
        "results": {"num": ["v:2!"]},
    }
    assert set(written) == {("d.x/A.report.json", "d.x/A"), ("d.x/b.report.json", "d.x/b.txt")}
    assert written["d.x/A.report.json", "d.x/A"] == json.dumps(own, indent=4) + "\n"


def test_a_written_report_can_be_tested_again(spark, plain_run, tmp_path):
    plain_run.save(str(tmp_path / "r"))
    again = parts.extract_parts(files.read_report(spark, str(tmp_path / "r")), entries_of({"k": {"extract": "v:[0-9]+"}}))
    assert {(r.key, r.value) for r in again.collect()} == {("k", "v:1"), ("k", "v:2")}


def test_results_survive_a_round_trip(spark, tmp_path):
    rows = [("q", f"u{i}", i) for i in range(25)] + [("r", "x", 7)]
    df = spark.createDataFrame(rows, "query STRING, url STRING, pos BIGINT")
    writers.write_results(df, str(tmp_path / "r"), chunk=10)
    back = files.read_result_lines(spark, str(tmp_path / "r")).orderBy("query", "pos").collect()
    assert [(r.query, r.url) for r in back] == [(q, u) for q, u, _ in rows]


def test_downloads(spark, tmp_path):
    wanted = spark.createDataFrame([(u,) for u in ("http://a/x", "http://b/x", "http://c/x", "http://d/")], "url STRING")
    fetched = responses(spark, ("http://a/x", 200, b"1"), ("http://b/x", 404, b"2"), ("http://c/x", 200, "é"), ("http://d/", 200, b""))
    writers.write_downloads(wanted, fetched, str(tmp_path / "d"), "dir")
    rows = {r.url: (r.filename, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert set(rows) == {"http://a/x", "http://c/x"}
    assert {name for name, _ in rows.values()} == {"dir/x", "dir/x (1)"}
    assert rows["http://c/x"][1] == "é".encode()


def test_search_run(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://h{i}.example.com/", f"<p>join t.me/{i}</p>") for i in range(5)]
        + [(9, "http://example.com/google-dork", "<p>t.me/9</p>"), (10, "http://other.org/", "<p>t.me/10</p>")],
        "page_id BIGINT, url STRING, html STRING",
    )
    run = search_run(pages, files.literal_queries(spark, [*SOCIAL_QUERIES, "site:x y"]), "*.example.com", limit=3)
    assert [(r.url, r.pos) for r in run.results.orderBy("pos").collect()] == [(f"http://h{i}.example.com/", i + 1) for i in range(3)]
    assert [r.query for r in run.ignored.collect()] == ["site:x y"]
    assert {r.links for r in run.links().collect()} == {0, 3}
    assert run.save(str(tmp_path / "r"))
    nothing = search_run(pages, files.literal_queries(spark, ["absent"]))
    assert not nothing.save(str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError, match="no valid"):
        search_run(pages, files.literal_queries(spark, ["site:x"]), "y")


def test_search_and_extract_fit_together(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>t.me/x</p>")], "page_id BIGINT, url STRING, html STRING")
    found = search_run(pages, files.literal_queries(spark, ['intext:"t.me/"'])).results.withColumn("file", F.lit("f"))
    run = extract_run(found, responses(spark, ("http://a/", 200, "t.me/x")), social_template())
    assert {(r.stage, r.url, r.outcome) for r in run.outcomes().collect()} == {
        ("extraction", "http://a/", "success"), ("validation", "https://t.me/x", "error"),
    }


def test_one_url_under_two_names_keeps_all_files(spark):
    sources = spark.createDataFrame([("u", "f"), ("u", "f"), ("u", "g")], "url STRING, file STRING")
    by_file = report.page_files(extraction(spark, [("u", "success", {"num": ["v"]})]), sources)
    assert sorted(r.file for r in by_file.collect()) == ["f", "g"]
    assert report.select_by_file(by_file, "g").count() == 1
    assert {r.file for r in report.select_files(by_file).collect()} == {"f", "g"}


def test_hot_copies_of_a_response_are_one(spark):
    pages = responses(spark, *[("u", 200, "n1")] * 50, ("v", 200, "n2"))
    assert tables.one_per_url(pages).count() == 2


def test_files_with_one_report_name_are_kept_apart(spark, tmp_path):
    sources = spark.createDataFrame([("u", "d/a.json"), ("w", "d/a.txt")], "url STRING, file STRING")
    done = extraction(spark, [("u", "success", {"num": ["v"]}), ("w", "success", {"num": ["x"]})])
    nothing = spark.createDataFrame([], "url STRING, key STRING, outcome STRING")
    by_file = report.page_files(done, sources)
    lines = report.file_reports(by_file, nothing, validate.validation_input(by_file, TEMPLATE))
    writers.write_file_reports(lines, str(tmp_path / "r"))
    written = read_file_reports(spark, tmp_path / "r")
    assert {k: json.loads(v)["summary"]["extracted"] for k, v in written.items()} == {
        ("d/a.report.json", "d/a.json"): ["v"], ("d/a.report.json", "d/a.txt"): ["x"],
    }


def test_reports_of_files_with_long_names(spark, tmp_path):
    name = "/".join(["folder with a long name"] * 18) + ".json"
    done = extraction(spark, [("u", "success", {"num": ["v"]})])
    by_file = report.page_files(done, spark.createDataFrame([("u", name)], "url STRING, file STRING"))
    nothing = spark.createDataFrame([], "url STRING, key STRING, outcome STRING")
    writers.write_file_reports(report.file_reports(by_file, nothing, validate.validation_input(by_file, TEMPLATE)), str(tmp_path / "r"))
    assert len(name) > 400 and [k[1] for k in read_file_reports(spark, tmp_path / "r")] == [name]
