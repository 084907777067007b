"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import byte_cnn, chat_layouts, gbt_quality, histogram_packing, label_shards, periodic_runs, piece_codec, repetition, separator_scan
from pagesift.llm import simhash_bktree, stream_dedup, turn_repair, warc_members
from pagesift.llm.common import documents, fresh_dir, is_held_out, text_of
from pagesift.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered
def op1_piece_codec(spark, sf):
    """Every document encoded and decoded; digests of both."""
    coded = piece_codec.encode(documents(spark, sf), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@registered
def op5_gbt_quality(spark, sf):
    """The quality score of every document."""
    docs = documents(spark, sf)
    trees = gbt_quality.learn(docs, table(spark, sf, "labels"))
    scores = gbt_quality.quality(docs, ["doc_id"], trees)
    return scores.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@registered
def op8_repetition_rules(spark, sf):
    """Word, symbol, line and repeat measures of every document, and the verdict."""
    return repetition.repetition_rules(documents(spark, sf), ["doc_id"]).drop("spans")


@registered
def op10_byte_cnn(spark, sf):
    """The language of every document."""
    docs = documents(spark, sf)
    found = byte_cnn.identify(docs, ["doc_id"], byte_cnn.learn(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


@registered
def op7_stream_dedup(spark, sf):
    """Every document with the one that stays for its text."""
    found = stream_dedup.dedup(documents(spark, sf).select("doc_id", "text"), ["doc_id"])
    return found.select("doc.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLES["op7_stream_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


#: end-of-document id of the byte vocabulary; where it ends documents, its name in a text is ordinary text, so no text's ids hold it
END_OF_DOCUMENT = 50256
#: names that are one id in a text, as the vocabulary's tokenizer has it
SPECIALS = (("<|endoftext|>", END_OF_DOCUMENT),)


@registered
def op6_separator_scan(spark, sf):
    """Token counts of every document, found in flat token files written from the documents."""
    ranks, folder = public_tokenizers.path("byte_bpe_50k.tiktoken"), separator_scan.flat_dir(spark)
    places = separator_scan.write_flat(documents(spark, sf), ranks, public_tokenizers.PATTERN, END_OF_DOCUMENT, folder)
    counts = separator_scan.token_counts(spark, folder, END_OF_DOCUMENT)
    return places.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


@registered
def op9_histogram_packing(spark, sf):
    """The pieces of every document and where they are in which sequence."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = histogram_packing.pieces(documents(spark, sf), ["doc_id"], ranks, public_tokenizers.PATTERN, specials=SPECIALS)
    keep = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    return histogram_packing.place(spark, cut, keep).drop("piece")


@registered
def op3_simhash_bktree(spark, sf):
    """The fingerprint of every document and the component it is in."""
    found = simhash_bktree.near_duplicates(documents(spark, sf))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@registered
def op4_warc_members(spark, sf):
    """Every page written to an archive, the archives normalised, and every record read back."""
    source, target = fresh_dir(spark, "warc"), fresh_dir(spark, "warc")
    archives = warc_members.write_archives(table(spark, sf, "pages"), source)
    index = warc_members.normalise(archives, source, target)
    return warc_members.read_records(index, target, payload=False)


@registered
def op2_label_shards(spark, sf):
    """Every document in one of 16 shards of equal counts, copies kept together as far as that allows."""
    body = text_of()
    docs = materialize(
        documents(spark, sf).select(
            F.monotonically_increasing_id().alias("node"),
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("sha"),
        ),
        "documents",
    )
    links = materialize(label_shards.equal_links(docs, "node", "sha"), "links")
    placed = label_shards.slots(label_shards.propagate(docs, "node", links, 16), "node", docs.count())
    return docs.join(placed, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLES["op4_warc_members"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS sha, max(page_id) OVER (PARTITION BY body) AS response FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(40), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('123456789abcdef', sha[i + 1]) + 1, 4
  )), 'string_agg', '') AS bits FROM h
)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1
  ]), 'string_agg', '') AS payload_digest,
  CASE WHEN response IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM b
"""


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by a hash of its id, gets into a loop of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    sized = split.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rest = F.col("n") - F.col("a")
    period = sized.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    # whole copies of one period, cut to what is left
    copies = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil(rest / F.col("p")).cast("int")))
    looped = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(copies, F.lit(1), rest.cast("int")))
    return period.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


@registered
def op11_periodic_runs(spark, sf):
    """The runs of every document, some of which loop, and digests of runs and collapsed text."""
    found = periodic_runs.periodic_runs(with_loops(documents(spark, sf)), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
    start, length, period = -F.col("best.back"), F.col("best.length"), -F.col("best.short")
    own = best.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), "runs_sha256", "collapsed_sha256")
    return own.withColumn("exponent_milli", F.expr("1000 * length div period"))


@registered
def op12_chat_layouts(spark, sf):
    """Every conversation as a record of some layout, made turns, formatted with a loss mask, and read back."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(-7).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    records = chat_layouts.conversation_records(rows.unionByName(marks))
    read = chat_layouts.read_back(chat_layouts.formatted(chat_layouts.canonical(records)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op12_chat_layouts"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, role || chr(10) || text || chr(10) AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 26 + length(role) + length(regexp_replace(role, '[^\\]', '', 'g'))
      + len(regexp_extract_all(role, '\[/?INST\]|</?s>|<</?SYS>>|<</?ROLE>>|<</TURN>>')) END
      + length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|<</?ROLE>>|<</TURN>>')) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(trained))::BIGINT AS loss_chars, sha256(string_agg(trained, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@registered
def op13_turn_repair(spark, sf):
    """Every conversation, damaged by a hash of its rows, with its faults and its cheapest repair."""
    rows = table(spark, sf, "conversations")
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("hit"))
    damaged = hit.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))),
    )
    return turn_repair.repaired(damaged, gone=F.col("gone"))
