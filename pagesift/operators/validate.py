"""Validation: extracted values are URLs; their content is tested with a second pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import patterns, urls
from pagesift.operators import fetch
from pagesift.operators.extract import result_values
from pagesift.operators.skew import SALT_ROWS, join_hot
from pagesift.session import materialize
from pagesift.sources.tables import copy_order, latest
from pagesift.sources.templates import Template, template_for_stage, template_table


def template_semi_join(values: DataFrame, template: Template) -> DataFrame:
    """Values whose key still has an entry with a validation pattern."""
    active = template_table(values.sparkSession, template_for_stage(template, schemas.VALIDATION))
    return values.join(F.broadcast(active.select("key")), "key", "left_semi")


def validation_values(extraction: DataFrame, template: Template) -> DataFrame:
    """(url, key): distinct extracted values to be validated, each an URL of its own."""
    values = result_values(extraction, [])
    return template_semi_join(values, template).select(F.col("value").alias("url"), "key").distinct()


def validation_input(
    extraction: DataFrame, template: Template, source_files: DataFrame | None = None, salt_rows: int = SALT_ROWS
) -> DataFrame:
    """(url, key, file): extracted values with the files they come from.

    ``source_files`` holds (url, file) of the pages. Without it the extraction is one of plain text
    and names its file itself.
    """
    if source_files is None:
        values = result_values(extraction, ["file"])
    else:
        values = result_values(extraction.withColumnRenamed("url", "page"), ["page"])
    values = template_semi_join(values, template).withColumnRenamed("value", "url")
    if source_files is not None:
        pages = source_files.select(F.col("url").alias("page"), "file").distinct()
        values = join_hot(pages, values, "page", "file", salt_rows=salt_rows)
    return values.select("url", "key", "file").distinct()


def last_key(values: DataFrame, template: Template) -> DataFrame:
    """(url, key): of several keys of one URL the last one in template order counts.

    Pages come in random order, so any of their last keys may win; the largest template position is
    one of them, is always the same, and needs only a maximum of numbers.
    """
    position = F.coalesce(*[F.when(F.col("key") == e.key, e.ord) for e in template])
    key = F.coalesce(*[F.when(F.col("ord") == e.ord, F.lit(e.key)) for e in template])
    return values.groupBy("url").agg(F.max(position).alias("ord")).select("url", key.alias("key"))


def group_by_url(
    inputs: DataFrame, template: Template, per_key: bool = False, salt_rows: int = SALT_ROWS
) -> DataFrame:
    """(url, key, file): each URL with one key and all its files, as distinct rows.

    The files of a URL stay rows: a popular URL may come from a third of all files. With
    ``per_key`` a URL keeps all its keys.
    """
    if per_key:
        return inputs.select("url", "key", "file").distinct()
    files = inputs.select("url", "file").distinct()
    return join_hot(files, last_key(inputs, template), "url", "file", salt_rows=salt_rows).select("url", "key", "file")


def validate_match(content: Column, key: Column, template: Template) -> Column:
    """Does the content match the validation pattern of its key, anywhere?"""
    matched = F.lit(False)
    for entry in template_for_stage(template, schemas.VALIDATION):
        matched = F.when(key == entry.key, patterns.like(content, entry.validate)).otherwise(matched)
    return matched


def matched_keys(content: Column, lower: Column, template: Template, keys: Column | None = None) -> Column:
    """The keys whose validation pattern the content matches; of ``keys`` alone, where they are known."""

    def asked(key: str) -> Column:
        return F.lit(True) if keys is None else keys.isNull() | F.array_contains(keys, key)

    return F.array_compact(
        F.array(
            *[
                F.when(asked(e.key) & patterns.contains_match(content, lower, e.validate), F.lit(e.key))
                for e in template_for_stage(template, schemas.VALIDATION)
            ]
        )
    )


def validate_urls(
    extraction: DataFrame,
    responses: DataFrame,
    template: Template,
    per_key: bool = False,
    order_by: str | None = None,
    max_broadcast: int = fetch.BROADCAST_BYTES,
) -> DataFrame:
    """(url, key, outcome): stage two, one row per extracted URL (and key, with ``per_key``).

    Values are reduced to distinct URLs; files play no part. As in stage one, a URL meets the response of any URL that leads to
    the same request, and content is tested where it is read. Where the URLs are few enough to be broadcast, their keys come along and only their
    patterns run; otherwise all do, which is cheaper than a shuffle of the content. Only the matching keys travel to the join. The URLs are written
    once, to be measured and joined twice.
    """
    values = validation_values(extraction, template)
    inputs = values if per_key else last_key(values, template)
    inputs = materialize(inputs.withColumn("request", urls.canonical(F.col("url"))), "targets")
    # as many keys as the template has entries
    requests = inputs.groupBy("request").agg(F.collect_set("key").alias("keys"))
    fetched = responses.withColumn("request", urls.canonical(F.col("url")))
    pages = fetch.only_wanted(fetched, requests, max_broadcast, "request", ("keys",)).select(
        "request", "keys", copy_order(order_by, "status", "error", "text", "body").alias("copy"), fetch.content().alias("text")
    )
    lowered = pages.withColumn("lower_text", F.lower("text"))
    found = matched_keys(F.col("text"), F.col("lower_text"), template, F.col("keys"))
    matches = F.when(F.col("text").isNotNull(), found)
    # a generator, so that nothing is pushed below the pattern work
    tested = lowered.select("request", "copy", F.inline(F.array(F.struct(matches.alias("matches")))))
    tested = materialize(tested.withColumn("number", F.monotonically_increasing_id()), "tested")
    joined = inputs.join(latest(tested, "request", "copy"), "request", "left")
    matched = F.array_contains("matches", F.col("key"))
    return joined.select("url", "key", fetch.outcome(F.col("matches").isNotNull(), matched).alias("outcome"))
