from datetime import date
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from pagesift.functions import text, urls
from pagesift.operators.distinct import sort_casefold


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [row[1] for row in df.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_strip_takes_every_kind_of_space(spark):
    values = [" a ", "\t\x0b\x1ca b\x85\xa0\r\n", "", "   ", "\u2003x\u3000", "a\n"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_sorted_distinct_keeps_first_of_equal_keys(spark):
    df = spark.createDataFrame([(["b", "A", "a", "B", "b", "A"],)], "v ARRAY<STRING>")
    assert df.select(text.sorted_distinct(F.col("v"))).first()[0] == ["A", "a", "b", "B"]


def test_file_text(spark):
    df = spark.createDataFrame([(b"\xef a\r\nb\rc\xe9 \n",)], "v BINARY")
    assert df.select(text.file_text(F.col("v"))).first()[0] == "ï a\nb\ncé"


def test_visible_text_and_title(spark):
    html = '<title lang="x">A\nb</title><script>var t="</p>"</script><!-- c --><p>Hi</p><style>q</style>'
    assert column(spark, [html], text.title_text) == ["A\nb"]
    assert column(spark, [html], text.visible_text)[0].split() == ["A", "b", "Hi"]


def test_month_floor_keeps_to_the_end_of_a_month(spark):
    assert spark.range(1).select(text.month_floor("2024-03-31", 1)).first()[0] == date(2024, 2, 29)


URLS = [
    "http://a.b/c/d.html?x=1#f",
    "HTTPS://A.b:80",
    "//host/p",
    "mailto:a@b.c",
    "path/only",
    "http://h/a b?q=%20#",
    "http://h?",
    "  http://h/\tx",
    "1http://h/",
    "http://u:p@[::1]:8080/x",
    "",
    "?q",
    "#f",
    "a:b:c",
    "https:///a/b",
    "http:",
    "http:a",
    "http:/a?q",
    "custom:///a",
    "custom:",
    "////a/b",
    "http:////a/b",
    "file:///etc",
    "http://?q",
    "http:?q#f",
]


def test_split_equals_the_standard_library(spark):
    for part, name in ((urls.scheme, "scheme"), (urls.netloc, "netloc"), (urls.path, "path"), (urls.query, "query"), (urls.fragment, "fragment")):
        assert column(spark, URLS, part) == [getattr(urlsplit(u), name) for u in URLS], name


def test_normalize_equals_the_standard_library(spark):
    assert column(spark, URLS, urls.normalize) == [urlsplit(u).geturl() for u in URLS]


@pytest.mark.parametrize(
    ("url", "problem"),
    [
        ("host/p", "scheme_missing"),
        ("", "scheme_missing"),
        ("ftp://h/", "scheme_not_allowed"),
        ("http:///p", "no_network_location"),
        ("http://h:0/", "port_out_of_range"),
        ("http://h:65536/", "port_out_of_range"),
        ("http://h:99999999999999999999/", "port_out_of_range"),
        ("http://h:x/", "port_out_of_range"),
        ("http://h:65535/", "ok"),
        ("http://h:/", "ok"),
        ("http://[::1]/", "ok"),
        ("http://[::1]:70000/", "port_out_of_range"),
        ("SOCKS5H://u:p@h:1080", "ok"),
    ],
)
def test_url_problem(spark, url, problem):
    assert column(spark, [url], urls.url_problem) == [problem]


def test_redirected(spark):
    df = spark.createDataFrame([("HTTP://h/?", "http://h/"), ("http://h", "http://h/")], "u STRING, f STRING")
    assert [r[0] for r in df.select(urls.redirected(F.col("u"), F.col("f"))).collect()] == [False, True]


def test_host_and_extension(spark):
    assert column(spark, ["http://U@A.B:80/x.y/z.PDF?q.html", "http://h/a.b/c", "x"], urls.host) == ["a.b", "h", ""]
    assert column(spark, ["http://h/x.y/z.PDF?q.html", "http://h/a.b/c", "http://h/.x"], urls.extension) == ["pdf", "", "x"]


def test_canonical(spark):
    values = ["http://H/?b=2&a=1&a=0#f", "http://h/?a=0&a=1&b=2", "http://h?", "http://h/p?a-b=1&a=2&c", "http://h/p?c=&a=2&a-b=1"]
    found = column(spark, values, urls.canonical)
    assert found[0] == found[1] == "http://h/?a=0&a=1&b=2"
    assert found[2] == "http://h/"
    assert found[3] == found[4] == "http://h/p?a=2&a-b=1&c="


def test_strip_text_fragment(spark):
    values = ["http://h/#:~:text=a#:~:text=b", "http://h/#x"]
    assert column(spark, values, urls.strip_text_fragment) == ["http://h/", "http://h/#x"]


def test_full_case_folding(spark):
    """The key of every character, and of texts with folded ones, is Python's; so the order is."""
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c) != chr(c).casefold() or c < 0x250)]
    values = characters + [f"a{c}B" for c in characters[::7]] + ["", "STRASSE", "straße", "STRAẞE", "ﬁn", "FIN", "İ", "i̇", "ΌΣΟΣ", "όσος", "😀É"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    assert all(r.key == r.v.casefold() for r in df.select("v", text.casefold_key(F.col("v")).alias("key")).collect())
    assert [r.v for r in sort_casefold(df, "v").collect()] == sorted(values, key=lambda v: (v.casefold(), v))
    arrays = df.groupBy().agg(F.collect_list("v").alias("all")).select(text.sorted_distinct(F.col("all")).alias("sorted"))
    folded = [v.casefold() for v in arrays.first()["sorted"]]
    assert folded == sorted(folded) and len(folded) == len(set(values))
