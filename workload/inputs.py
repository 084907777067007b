"""Inputs the test tables lack, derived from them by Spark expressions.

``workload.oracles`` derives the same rows in SQL.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.functions import text
from pagesift.operators import search
from pagesift.session import materialize, shared_dir
from pagesift.sinks.writers import write_results
from pagesift.sources.tables import read_pages
from pagesift.sources.templates import Template, parse_template

SITE = "example.org"
ASOF = "2024-02-20"

#: search queries over the page table, written with every operator
SEARCHES = (
    'intitle:"the" -intext:"casino"',
    'intext:"tion the" OR intext:"die der"',
    "site:*.example.com ext:html",
    'site:example.org intext:"que"',
    '"cheap-pills" OR "spam-farm"',
    "ext:html OR ext:pdf -site:example.net",
)

#: patterns both regex dialects read alike; link and nav find the same values on purpose
TEMPLATE_JSON = json.dumps(
    {
        "link": {
            "extract": 'href="(/[^"]*)"',
            "extract_prepend": "https://example.org",
            "validate": "not found",
            "validate_headers": {"Accept": "text/html", "X-Test": "1", "COOKIE": "ignored"},
            "validate_cookies": {"Lang": "en", "b": "2"},
        },
        "title": {"extract": r"<title>([^<]*)</t\x69tle>"},
        "heading": {"extract": "<h1>([^<]*)</h1>", "extract_append": " (h1)"},
        "email": {
            "extract": "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+",
            "extract_prepend": "mailto:",
            "validate": "welcome",
        },
        "nav": {
            "extract": r'<li><a href=\x22(?P<path_part>/[^"]*)"',
            "extract_prepend": "https://example.org",
            "validate": r"not\x20found|moved",
            "validate_browser": True,
            "validate_browser_wait": 1.5,
        },
    }
)

TEXT_TEMPLATE_JSON = json.dumps(
    {
        "email": {
            "extract": "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+",
            "extract_prepend": "mailto:",
            "validate": "welcome",
        },
        "ip": {"extract": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"},
    }
)

#: patterns that pass the check, and some that must not
CANDIDATES = (
    "<h1>", r"\x3ch1\x3e[A-Z]", r"\p{Lu}[a-z]+!", "(a)(b)", "[[:alpha:]]", r"(?P<one_word>the) (?:end|\x74he)", "(a", r"</html>\s*\Z", "[a&&b]", "[[<]h1[>||~]",
)

EXCLUDES = ('<a href="/[^"]*">d[^<]*</a>', "<!--[^>]*-->")


def template() -> Template:
    return parse_template(TEMPLATE_JSON)


def text_template() -> Template:
    return parse_template(TEXT_TEMPLATE_JSON)


def social_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with links added to their whole text: accounts, shares and look-alikes."""
    n = F.col("page_id")
    account = F.format_string(
        ' <a href="https://t.me/User_%1$d">x</a> https://X.com/jack%1$d https://twitter.com/home'
        " https://pic.twitter.com/zz facebook.com/sharer/x facebook.com/face%1$d discord.gg/invite/i%1$d. instagram.com/p/x instagram.com/in.%1$d",
        n,
    )
    company = F.format_string(
        " linkedin.com/company/c&%1$d linkedin.com/in/u-%1$d vt.tiktok.com/@no youtube.com/watch youtube.com/c/tube%1$d tiktok.com/@a.%1$d", n
    )
    added = F.when(n % 3 == 0, account).when(n % 3 == 1, company).otherwise(" https://t.me/share?url=x")
    return page_texts(spark, sf).withColumn("text", F.concat("text", added))


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """(query, pos): for each page a query for two words of its visible text, in the text or the title of pages that aren't PDF files."""
    words = F.regexp_extract_all(text.visible_text(F.lower("html")), F.lit(r"\S+"), F.lit(0))
    phrase = F.array_join(F.slice(words, 20, 2), " ")
    found = pages(spark, sf).select(F.col("page_id").alias("pos"), phrase.alias("p")).where((F.col("p") != "") & ~F.contains("p", F.lit('"')))
    return found.select(F.concat(F.lit('intext:"'), "p", F.lit('" OR intitle:"'), "p", F.lit('" -ext:pdf')).alias("query"), "pos")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", "url", F.col("html").alias("text"))


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as plain-text files."""
    documents = read_pages(spark, f"{sf}/documents.parquet")
    return documents.select(F.format_string("doc_%d.txt", "doc_id").alias("file"), "text")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query, pos): every line of every document as a search query, with a site operator in front."""
    lines = read_pages(spark, f"{sf}/documents.parquet").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    kind = F.col("doc_id") % 5
    operator = (
        F.when(kind == 0, "site:example.com ")
        .when(kind == 1, "-site:example.com ")
        .when(kind == 2, "insite:x ")
        .when(kind == 3, "x nSite:y ")
        .otherwise("")
    )
    stripped = text.strip(F.col("line"))
    return lines.where(stripped != "").select(
        F.concat(operator, stripped).alias("query"), (F.col("doc_id") * 1_000_000 + F.col("i")).alias("pos")
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    """(query, url, pos, file): the pages every search finds, spread over four result files."""
    found = search.search_pages(pages(spark, sf), SEARCHES)
    return found.withColumn("file", F.format_string("results_%d.json", F.col("pos") % 4))


def raw_results(spark: SparkSession, sf: str) -> DataFrame:
    """(query, url, pos): page URLs with text fragments and with URLs about search tricks."""
    n = F.col("page_id")
    trick = (
        F.when(n % 6 == 0, F.format_string("https://www.exploit-db.com/%d", n))
        .when(n % 6 == 1, F.format_string("http://a.example.com/google-dork/%d", n))
        .when(n % 6 == 2, F.format_string("http://a.example.com/googleedork/%d", n))
        .when(n % 6 == 3, F.format_string("http://a.example.com/google+dork/%d", n))
        .when(n % 6 == 4, F.format_string("http://a.example.com/GOOGLE%%20HACK/%d", n))
    )
    fragment = F.when(n % 5 == 0, F.concat("url", F.lit("#:~:text=x#:~:text=y")))
    urls = F.filter(F.array("url", fragment, trick), lambda u: u.isNotNull())
    query = F.when(n % 3 == 0, "site:example.com x").otherwise('intext:"x" -site:y')
    return (
        pages(spark, sf).select(query.alias("query"), "page_id", F.posexplode(urls).alias("i", "url"))
        .select("query", "url", (F.col("page_id") * 10 + F.col("i")).alias("pos"))
    )


def odd_urls(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url): page URLs bent in nine ways."""
    n = F.col("page_id")
    bent = (
        F.when(n % 8 == 0, F.concat(F.lit("  "), "url", F.lit("?")))
        .when(n % 8 == 1, F.regexp_replace("url", "^https?", "HTTP"))
        .when(n % 8 == 2, F.regexp_replace("url", "^https?://", ""))
        .when(n % 8 == 3, F.regexp_replace("url", "^https?", "ftp"))
        .when(n % 16 == 4, F.regexp_replace("url", "//[^/]*", "//"))
        .when(n % 16 == 12, F.regexp_replace("url", "//.*", ""))
        .when(n % 8 == 5, F.regexp_replace("url", "(//[^/]*)", "$1:70000"))
        .when(n % 8 == 6, F.regexp_replace("url", "//([^/]*)", "//u:p@$1:8080"))
        .otherwise(F.concat("url", F.lit("#")))
    )
    return pages(spark, sf).select("page_id", bent.alias("url"))


def same_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(url, file): page URLs, each with copies that lead to the same request."""
    copies = F.array(
        F.col("url"),
        F.concat(F.substring_index("url", "#", 1), F.lit("#x")),
        F.when(F.col("url").endswith("?page=2&ref=x"), F.replace("url", F.lit("page=2&ref=x"), F.lit("ref=x&page=2"))),
    )
    return (
        pages(spark, sf).select("page_id", F.posexplode(copies).alias("i", "url")).where("url IS NOT NULL")
        .select("url", F.format_string("results_%d.json", (F.col("page_id") + F.col("i")) % 4).alias("file"))
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages: some failed, some missing, some fetched twice (the later time counts)."""
    n = F.col("page_id")
    status = F.when(n % 10 == 0, 500).when(n % 10 == 1, 404).otherwise(200)
    fetched = pages(spark, sf).where(n % 10 != 2)
    tries = F.when(n % 7 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    tried = fetched.withColumn("fetched_at", F.explode(tries))
    return tried.select(
        "url",
        F.col("url").alias("final_url"),
        F.when(F.col("fetched_at") == 1, 503).otherwise(status).alias("status"),
        F.lit(None).cast("binary").alias("body"),
        F.col("html").alias("text"),
        F.lit(None).cast("string").alias("error"),
        "fetched_at",
    )


def value_responses(values: DataFrame) -> DataFrame:
    """Fetched content of extracted values (url, …): what it says depends on the length of the URL."""
    n = F.length("url")
    body = F.when(n % 3 == 0, "Page Not Found").when(n % 3 == 1, "It has moved").otherwise("Welcome")
    return values.select("url").distinct().where(n % 11 != 0).select(
        "url",
        F.col("url").alias("final_url"),
        F.when(n % 7 == 0, 500).otherwise(200).alias("status"),
        F.encode(body, "ISO-8859-1").alias("body"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def numbered_urls(spark: SparkSession, sf: str) -> DataFrame:
    """(url): raw result URLs, and copies whose last segment has a number in brackets already."""
    raw = raw_results(spark, sf).select("url")
    n = F.col("page_id") % 3
    numbered = pages(spark, sf).select(F.concat(F.lit("http://n.example.com/"), F.col("page_id") % 5, F.lit("/index.html ("), n, F.lit(")")).alias("url"))
    plain = pages(spark, sf).select(F.concat(F.lit("http://p.example.com/"), F.col("page_id"), F.lit("/index.html")).alias("url"))
    return raw.union(numbered).union(plain)


def written(df: DataFrame, name: str) -> str:
    """A new folder of the shared folder for files of a round trip."""
    return f"{shared_dir(df.sparkSession)}/pagesift/{name}-{uuid.uuid4().hex}"


def document_files(spark: SparkSession, sf: str) -> str:
    """A folder with a text file per thousand documents, each document followed by a line end, in order of id."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", "text")
    folder = written(documents, "documents")
    ordered = documents.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text")
    ordered.write.partitionBy("part").text(folder)
    return folder


def saved_searches(spark: SparkSession, sf: str) -> str:
    """A folder with a saved search per file of ``results``."""
    rows = materialize(results(spark, sf), "results")
    folder = written(rows, "searches")
    for i in range(4):
        name = f"results_{i}.json"
        write_results(rows.where(F.col("file") == name).drop("file"), f"{folder}/{name}", chunk=50)
    return folder


def result_arrays(spark: SparkSession, sf: str) -> str:
    """A folder with a JSON array per thousand pages: a raw result each element, with a field that no reader knows and that holds brackets."""
    folder = written(raw_results(spark, sf), "arrays")
    rows = raw_results(spark, sf).withColumn("part", F.floor(F.col("pos") / 10_000))
    odd = F.struct(F.lit('}]{"\\').alias("a"), F.array(F.struct("pos")).alias("b"))
    order, whole = Window.partitionBy("part").orderBy("pos"), Window.partitionBy("part")
    lines = rows.withColumns({"i": F.row_number().over(order), "rows": F.count(F.lit(1)).over(whole)}).select(
        "part",
        "pos",
        F.concat(
            F.when(F.col("i") == 1, "[").otherwise(","),
            F.to_json(F.struct(odd.alias("odd"), "query", F.array("url").alias("urls"))),
            F.when(F.col("i") == F.col("rows"), "]").otherwise(""),
        ).alias("line"),
    )
    lines.repartition("part").sortWithinPartitions("part", "pos").select("part", "line").write.partitionBy("part").text(folder)
    return folder


def text_file(spark: SparkSession, name: str, text_: str) -> str:
    """A file in the shared folder with this text, in one part."""
    df = spark.createDataFrame([(text_,)], "value STRING").coalesce(1)
    folder = written(df, name)
    df.write.text(folder)
    return folder
