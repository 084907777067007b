"""Patterns over texts that are cut into parts, with the matches that the whole text has.

A text is rows (file, part, text): lines, each of which ends with a line break. Most cuts are safe: a pattern that can't hold a line break never crosses one. For others a search is
made in each part for places from which the pattern could read on beyond its end (``dialect.open_end``); a part with such a place is joined with the next one, and looked at again. Between
safe cuts a search starts afresh, as it would in the whole text, so each match is found once, and only texts that a match may cross are moved. A pattern that depends on
the ends of the text, on an earlier line or on what a group held needs the whole text in one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import dialect, patterns
from pagesift.operators import extract
from pagesift.session import materialize
from pagesift.sources.templates import Template, template_for_stage

#: blocks of files that may be broadcast (a few hundred bytes each), and parts to be joined (some 100 bytes each); more are joined by a shuffle
BROADCAST_BLOCKS, BROADCAST_PARTS = 20_000, 100_000


def _with_break(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.concat("text", F.lit("\n")))


def _joined(rows: DataFrame, *by: str) -> DataFrame:
    """The parts of each group as one, under the first one's place."""
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("held"))
    text = F.array_join(F.transform("held", lambda p: p["text"]), "\n")
    return held.select("file", F.get("held", F.lit(0))["part"].alias("part"), text.alias("text"))


def _small(table: DataFrame, rows: int, most: int) -> DataFrame:
    """``table`` of ``rows`` rows as the lesser side of a join. The bytes of its files tell little of what it takes in memory, so Spark isn't left to broadcast it."""
    return F.broadcast(table) if rows <= most else table.hint("merge")


def _groups(marked: DataFrame, reach: int) -> DataFrame | None:
    """``marked`` with ``head``, the same for an open part and about ``reach`` parts behind it; null for parts that stay alone. None if all do.

    Lines are followed up within the block of the file they were read from, as rows of a few numbers; how blocks hang together is told by one row per
    block. Texts are moved once, by a join on their numbers.
    """
    place = ["file", "path", "block"]
    placed = marked.withColumns({c: F.col(f"part.{c}") for c in ("path", "block", "n")})
    blocks = materialize(placed.select(*place).distinct().withColumn("id", F.monotonically_increasing_id()), "blocks")
    count = blocks.count()
    rows = placed.join(_small(blocks, count, BROADCAST_BLOCKS), place).drop("path", "block")
    line, order = W.partitionBy("id").orderBy("n"), W.partitionBy("file").orderBy("path", "block")
    held = rows.select("id", "n", F.max("open").over(line.rowsBetween(1 - reach, 0)).alias("held"))
    held = materialize(held, "held_parts")
    ends = blocks.join(_small(held.groupBy("id").agg(F.max_by("held", "n").alias("runs_on")), count, BROADCAST_BLOCKS), "id")
    ends = ends.withColumn("follows", F.coalesce(F.max("runs_on").over(order.rowsBetween(-reach, -1)), F.lit(False)))
    ends = materialize(ends.withColumn("runs_over", F.lead("follows", 1, False).over(order)), "block_ends")
    lines = held.join(_small(ends.select("id", "follows", "runs_over"), count, BROADCAST_BLOCKS), "id")
    taken = F.coalesce(F.lag("held").over(line), F.lit(False)) | (F.col("follows") & (F.row_number().over(line) <= reach))
    # the groups of a block are numbered from 1; 0 is what belongs to the block before
    numbered = lines.withColumn("taken", taken).select(
        "id",
        "n",
        F.sum(F.when(F.col("taken"), 0).otherwise(1)).over(line).alias("group"),
        (F.col("taken") | F.coalesce(F.lead("taken").over(line), F.col("runs_over"))).alias("together"),
    )
    numbered = materialize(numbered, "numbered_parts")
    joined = numbered.where("together").count()
    if not joined:
        return None
    groups = numbered.groupBy("id").agg(F.max("group").alias("groups"))
    own = F.struct("id", F.col("groups").alias("group"))
    blocks = ends.join(_small(groups, count, BROADCAST_BLOCKS), "id")
    blocks = blocks.withColumn("last", F.last(F.when(F.col("groups") > 0, own), True).over(order)).withColumn("before", F.lag("last").over(order))
    members = numbered.where("together").join(_small(blocks.select("id", "before"), count, BROADCAST_BLOCKS), "id")
    head = F.when(F.col("group") == 0, F.col("before")).otherwise(F.struct("id", "group"))
    members = members.select("id", "n", head.alias("head"))
    return materialize(rows.join(_small(members, joined, BROADCAST_PARTS), ["id", "n"], "left").drop("id", "n"), "grouped_parts")


def joined_parts(parts: DataFrame, given: Sequence[str]) -> DataFrame:
    """``parts`` (file, part, text) joined until no match of a given pattern can cross a cut."""
    if any(dialect.needs_whole_text(p) for p in given):
        return _joined(parts, "file")
    crossing = [patterns.FLAGS + dialect.open_end(p) for p in given if dialect.crosses_lines(p)]
    if not crossing:
        return parts
    left = [F.regexp_replace(F.concat("text", F.lit("\n")), F.lit(p), F.lit("")) != "" for p in crossing]
    is_open = reduce(lambda a, b: a | b, left)
    parts, reach = parts.withColumn("open", is_open), 1
    while True:
        marked = materialize(parts, "marked_parts")
        if marked.where("open").isEmpty():
            return marked.drop("open")
        grouped = _groups(marked, reach)
        if grouped is None:  # only texts' last parts are open
            return marked.drop("open")
        reach = min(2 * reach, 1 << 30)  # so a match over many lines takes few rounds
        alone = grouped.where("head IS NULL").drop("head")
        together = _joined(grouped.where("head IS NOT NULL"), "file", "head").withColumn("open", is_open)
        parts = alone.unionByName(together)


def exclude_from_parts(parts: DataFrame, excludes: Sequence[str]) -> DataFrame:
    """Delete every match of each pattern, one pattern after the other."""
    for pattern in excludes:
        cut = extract.exclude_content(_with_break(joined_parts(parts, [pattern])), [pattern])
        parts = cut.withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    return parts


def extract_parts(parts: DataFrame, template: Template, excludes: Sequence[str] = ()) -> DataFrame:
    """(file, key, value): the distinct values that ``extract_plaintext`` finds in each whole text."""
    parts = exclude_from_parts(parts, excludes)
    entries = template_for_stage(template, schemas.EXTRACTION)
    crossing = [e for e in entries if dialect.crosses_lines(e.extract) or dialect.needs_whole_text(e.extract)]
    within = [e for e in entries if e not in crossing]
    found = []
    if within:
        found.append(extract.extract_results(_with_break(parts), within, ["file"], only_matched=True))
    if crossing:
        whole = joined_parts(parts, [e.extract for e in crossing])
        found.append(extract.extract_results(_with_break(whole), crossing, ["file"], only_matched=True))
    values = [extract.result_values(f, ["file"]) for f in found]
    return reduce(DataFrame.unionByName, values).distinct()
