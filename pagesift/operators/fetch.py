"""Between stages: what has to be fetched, and what a fetched response is worth."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import text, urls
from pagesift.operators.distinct import deterministic_shuffle
from pagesift.sources.templates import Template, template_table

#: fixed values: statuses besides 2xx whose content is looked at
CONTENT_STATUSES = (401, 403, 404)


def has_content() -> Column:
    """Is the response usable? A missing response is not."""
    status = F.col("status")
    return F.coalesce(
        F.col("error").isNull() & (status.between(200, 299) | status.isin(*CONTENT_STATUSES)), F.lit(False)
    )


def classify_response(df: DataFrame) -> DataFrame:
    """Add ``response``: ``content`` or ``error``."""
    return df.withColumn("response", F.when(has_content(), "content").otherwise("error"))


def decode_body(content_text: Column, body: Column, encoding: str = text.ENCODING) -> Column:
    """The text if there is one, else the decoded bytes, else an empty text."""
    return F.coalesce(content_text, text.decode(body, encoding), F.lit(""))


def content() -> Column:
    """The text of a usable response, null for any other."""
    return F.when(has_content(), decode_body(F.col("text"), F.col("body")))


#: a URL list up to this size is broadcast
BROADCAST_BYTES = 64 * 1024 * 1024


#: bits of one block of a URL filter, which a URL has all its bits in
BLOCK_BITS = 32768

#: bits per URL that a filter has at least, and more than which it never has
LEAST_BITS, MOST_BITS = 2, 16


def url_filter(wanted: DataFrame, key: str, n: int, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int, int] | None:
    """A Bloom filter of ``n`` keys in ``max_bytes``: its rows (block, bits), its blocks and bits per key; none if it would let most keys through.

    It is a table made by ``bitmap_construct_agg``: a row per block of 4 KB. Only numbers of 8 bytes are shuffled for it, once to make
    them distinct and once to bring a block together.
    """
    per_key = min(MOST_BITS, 8 * max_bytes // max(n, 1))
    if per_key < LEAST_BITS:
        return None
    blocks = max(1, min(n * per_key // BLOCK_BITS + 1, 8 * max_bytes // BLOCK_BITS))
    tests = max(1, round(per_key * 0.7))
    hashes = wanted.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).distinct()
    placed = hashes.select(_block(F.col("h"), blocks).alias("block"), "h").repartition("block")
    bits = placed.select("block", F.explode(F.array(*_places(F.col("h"), tests))).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), blocks, tests


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit("block")), F.lit(blocks))


def _places(h: Column, tests: int) -> list[Column]:
    """The bits of a key within its block: steps of an odd width from a start."""
    start, step = F.pmod(F.xxhash64(h, F.lit("start")), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(h, F.lit("step")), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return [F.pmod(start + step * i, F.lit(BLOCK_BITS)) for i in range(tests)]


def _may_be_in(bits: Column, h: Column, tests: int) -> Column:
    """Are all bits of the key set?"""

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8).cast("int") + 1)) != 0

    return reduce(and_, [is_set(place) for place in _places(h, tests)])


def only_wanted(
    responses: DataFrame, wanted: DataFrame, max_bytes: int = BROADCAST_BYTES, key: str = "url", with_columns: tuple[str, ...] = ()
) -> DataFrame:
    """Drop responses nobody asked for, where that is cheap.

    ``wanted`` is measured. A small one is broadcast, so the content of other pages is not looked
    at; ``with_columns`` come along, one row per key. A larger one is broadcast as hashes of 8 bytes, as long as these stay within
    ``max_bytes``: a page let through by chance falls out in the later join. So it does behind a Bloom filter of that size, which a still longer list
    becomes (64 MB hold 100 million URLs and let a tenth of the other pages through). Beyond two bits per URL all responses stay: sending page
    bodies through a shuffle would cost more than looking at them where they are. Without the columns, they are null.
    """
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    if size <= max_bytes:
        if with_columns:
            return responses.join(F.broadcast(wanted.select(key, *with_columns)), key)
        return responses.join(F.broadcast(wanted.select(key).distinct()), key, "left_semi")
    if 8 * n <= max_bytes:
        hashes = F.broadcast(wanted.select(F.xxhash64(key).alias("hash")).distinct())
        responses = responses.withColumn("hash", F.xxhash64(key)).join(hashes, "hash", "left_semi").drop("hash")
    elif made := url_filter(wanted, key, n, max_bytes):
        held, blocks, tests = made
        h = F.xxhash64(key)
        keyed = responses.withColumns({"wanted_hash": h, "block": _block(h, blocks)})
        meets = (keyed["block"] == held["block"]) & _may_be_in(held["bits"], keyed["wanted_hash"], tests)
        responses = keyed.join(F.broadcast(held), meets, "left_semi").drop("wanted_hash", "block")
    return responses.withColumns({c: F.lit(None).cast(wanted.schema[c].dataType) for c in with_columns})


def attach_responses(inputs: DataFrame, responses: DataFrame) -> DataFrame:
    """Each input with its response; an input without one keeps nulls.

    Both sides have one row per URL (see ``one_per_url``). Whether the inputs are broadcast is left
    to Spark, which knows their size at run time.
    """
    return inputs.join(responses, "url", "left")


def outcome(usable: Column, matched: Column) -> Column:
    """One of success, no match and error."""
    return (
        F.when(~usable, schemas.ERROR).when(matched, schemas.SUCCESS).otherwise(schemas.NO_MATCH)
    )


def stage_outcomes(extraction: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """(stage, url, outcome) of both stages."""
    first = extraction.select(F.lit(schemas.EXTRACTION).alias("stage"), "url", "outcome")
    if validation is None:
        return first
    return first.union(validation.select(F.lit(schemas.VALIDATION).alias("stage"), "url", "outcome"))


def has_outcome(outcomes: DataFrame, stage: str, kind: str) -> bool:
    """Is there any row of this outcome? Stops at the first one."""
    return not outcomes.where((F.col("stage") == stage) & (F.col("outcome") == kind)).isEmpty()


def status_counts(outcomes: DataFrame) -> DataFrame:
    """(stage, outcome, n): how many URLs ended how."""
    return outcomes.groupBy("stage", "outcome").agg(F.count(F.lit(1)).alias("n"))


def needs_browser(template: Template) -> bool:
    """Does any entry ask for a browser?"""
    return any(e.validate_browser for e in template)


def browser_keys(values: DataFrame, template: Template) -> DataFrame:
    """(key, urls, validate_browser, validate_browser_wait): URLs per key and how to fetch them."""
    table = template_table(values.sparkSession, template)
    per_key = values.groupBy("key").agg(F.countDistinct("value").alias("urls"))
    return per_key.join(F.broadcast(table.select("key", "validate_browser", "validate_browser_wait")), "key")


def fetch_plan(inputs: DataFrame, template: Template, seed: int = 0) -> DataFrame:
    """Work list for an outside fetcher, one row per request and key, in random but repeatable order.

    Of the URLs that lead to the same request the first is listed; its response counts for all.
    The template is broadcast: it comes from the driver and is as small there. A cookie among the
    headers is ignored; cookies are given as a map and as one header value.
    """
    table = template_table(inputs.sparkSession, template).select(
        "key", "validate_browser", "validate_browser_wait", "validate_headers", "validate_cookies"
    )
    pairs = F.transform(
        F.map_entries("validate_cookies"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    requests = inputs.groupBy(urls.canonical(F.col("url")).alias("request"), "key").agg(F.min("url").alias("url"))
    planned = requests.join(F.broadcast(table), "key", "left").select(
        "url",
        "key",
        urls.host(F.col("url")).alias("host"),
        F.coalesce("validate_browser", F.lit(False)).alias("browser"),
        F.coalesce("validate_browser_wait", F.lit(0.0)).alias("browser_wait"),
        F.map_filter("validate_headers", lambda name, _: name != "cookie").alias("headers"),
        F.col("validate_cookies").alias("cookies"),
        F.array_join(pairs, "; ").alias("cookie_header"),
    )
    return deterministic_shuffle(planned, seed=seed)
