"""Exact and near duplicates, components and shards against brute force."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pagesift.llm import jaccard_links, label_shards, simhash_bktree, stream_dedup
from pagesift.llm.components import components
from pagesift.llm.queries import REGISTRY
from pagesift.llm.simhash_bktree import fingerprints, linked, near_duplicates, shard_links, shard_masks
from tests.conftest import SF
from tests.llm.conftest import SCHEMA, TEXTS


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- exact ----------------------------------------------------------------------------------------


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[squeezed(text)].append(doc_id)
    return Counter((i, min(ids), len(ids), sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


def outcome(found):
    rows = found.select("doc.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("sha")).collect()
    kept = Counter(r.keep_id for r in rows if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == {r.keep_id for r in rows}
    return Counter((r.doc_id, r.keep_id, r.group_size, r.sha) for r in rows)


def test_copies(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert outcome(stream_dedup.dedup(odd_docs, odd_docs.columns)) == expected_copies(rows)
    assert outcome(stream_dedup.dedup(odd_docs, ["doc_id"], max_files=1)) == expected_copies(rows)
    assert outcome(stream_dedup.dedup(odd_docs, ["doc_id"], broadcast_keys=0)) == expected_copies(rows)
    assert stream_dedup.dedup(no_docs, ["doc_id"]).collect() == []


def test_full_content_decides_not_the_digest(odd_docs):
    """With one byte, or none, of the digest as key, different texts meet under one key."""
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for n in (0, 1):
        weak = stream_dedup.dedup(odd_docs, ["doc_id"], digest=lambda sha: F.substring(sha, 1, n))
        assert outcome(weak) == expected_copies(rows)


def test_a_missing_id_never_stays_before_another(spark):
    docs = spark.createDataFrame([(None, "same"), (7, "same"), (None, "alone")], "doc_id long, text string")
    rows = stream_dedup.dedup(docs, ["doc_id"]).select("doc.doc_id", "keep_id", "kept").collect()
    assert Counter(map(tuple, rows)) == Counter([(None, 7, False), (7, 7, True), (None, None, True)])


def test_state_lasts_from_run_to_run(spark, tmp_path):
    store, keys, checkpoint = (str(tmp_path / n) for n in ("store", "keys", "checkpoint"))
    for part in ([(5, "a"), (6, "b")], [(4, "a"), (7, "c")], [(1, "b"), (9, "a")]):
        stream_dedup.write_store(spark.createDataFrame(part, "doc_id long, text string"), ["doc_id"], store)
        stream_dedup.stream_keys(spark, store, keys, checkpoint, lambda sha: sha, 1)
    found = {(r.keep_id, r.n) for r in stream_dedup.latest_copies(spark, keys).collect()}
    assert found == {(4, 3), (1, 2)}


# --- near -----------------------------------------------------------------------------------------


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_near(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    least = {}
    for i, p in prints:
        least[p] = min(i, least.get(p, i))
    found = roots(least, [(a, b) for a in least for b in least if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for p, r in found.items():
        first[r] = min(least[p], first.get(r, least[p]))
    return Counter((i, f"{p:016x}", first[found[p]]) for i, p in prints)


def near(found):
    return Counter((r.doc_id, f"{r.print & (1 << 64) - 1:016x}", r.component_id) for r in found.collect())


def test_near_copies(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert near(near_duplicates(odd_docs)) == expected_near(rows)
    assert near_duplicates(no_docs).collect() == []


def test_near_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = REGISTRY["op3_simhash_bktree"](spark, SF).collect()
    assert Counter(map(tuple, rows)) == expected_near([(r.doc_id, r.text) for r in docs])


def test_shards_of_any_size_lose_no_link(spark):
    """Centres with prints within few bits of them, cut into parts of a few prints."""
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(60)}
    values |= {0, 1, 7, (1 << 64) - 1, 1 << 63}
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    prints = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in sorted(values)], "print long")
    for shard, rows in ((10_000, None), (8, None), (10_000, 1 << 40)):
        pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in shard_links(prints, "print", shard=shard, rows=rows).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        assert roots(values, pairs) == want
    assert [len(shard_masks(n)) for n in (10, 1 << 30, 1 << 40)] == [4, 10, 20]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4095), unique=True, max_size=80), st.integers(0, 3))
def test_tree(values, radius):
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius])
    pairs = linked(values, radius)
    assert roots(values, pairs) == want
    assert len(pairs) == len(values) - len(set(want.values()))


def test_fingerprint_of_few_words():
    bodies = [(t or "").encode() for t in TEXTS]
    assert fingerprints(bodies).tolist() == [plain_print(t) for t in TEXTS]
    assert fingerprints([]).tolist() == []


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1200)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    pairs = chain + star + loose + [(5, 5), (0, 1)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    linked_nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked_nodes if want[n] != n}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


# --- shards ---------------------------------------------------------------------------------------


def test_shards_of_documents(spark):
    rows = REGISTRY["op2_label_shards"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    groups = defaultdict(set)
    for r in rows:
        groups[docs[r.doc_id]].add(r.shard)
        assert r.size == len(docs[r.doc_id].encode()) + 1
    assert sum(len(s) > 1 for s in groups.values()) == 0


def placed_in(spark, pairs, n, shards):
    docs = spark.createDataFrame([(i,) for i in range(n)], "node long")
    links = spark.createDataFrame(pairs, "node long, key string")
    return {r.node: r.shard for r in label_shards.propagate(docs, "node", links, shards).collect()}


def even(placed, shards):
    sizes = Counter(placed.values())
    return max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1


def test_a_group_larger_than_a_shard_fills_whole_shards(spark):
    placed = placed_in(spark, [(i, "hot") for i in range(100)] + [(i, "small") for i in range(100, 105)], 300, 8)
    assert len(placed) == 300 and even(placed, 8)
    assert len({placed[i] for i in range(100, 105)}) == 1
    counts = sorted(Counter(placed[i] for i in range(100)).values())
    assert counts[-1] >= 30  # a shard of 37 or 38 holds 12 or 13 of them at the start


def test_neighbours_by_several_keys(spark):
    rng = random.Random(5)
    pairs = [(i, f"g{i // 10}") for i in range(200)] + [(i, f"h{i // 20}") for i in range(200) if rng.random() < 0.5]
    sizes = Counter(k for _, k in pairs)
    placed = placed_in(spark, [p for p in pairs if sizes[p[1]] > 1], 400, 4)
    assert even(placed, 4)
    split = sum(len({placed[i] for i in range(10 * g, 10 * g + 10)}) > 1 for g in range(20))
    assert split <= 5


def test_tables_in_which_every_text_has_copies(spark):
    """No document is without links: each text occurs two or three times."""
    for seed, sizes in ((1, (2,)), (2, (2, 3))):
        rng, pairs = random.Random(seed), []
        while len(pairs) < 1200:
            pairs += [(len(pairs) + i, f"g{len(pairs)}") for i in range(rng.choice(sizes))]
        placed = placed_in(spark, pairs, len(pairs), 16)
        assert len(placed) == len(pairs) and even(placed, 16)
        groups = defaultdict(list)
        for doc, key in pairs:
            groups[key].append(placed[doc])
        cut = sum(len(set(g)) > 1 for g in groups.values())
        assert cut <= len(groups) / 10


def test_exchanges_around_a_cycle():
    movers, fillers = label_shards.exchanges({(0, 1): 5, (1, 2): 4, (2, 0): 6, (1, 0): 1}, {}, 3)
    assert {w: n for w, n in movers.items() if n} == {(0, 1): 5, (1, 0): 1, (1, 2): 4, (2, 0): 4}
    assert not any(fillers.values())


def test_shards_without_links_or_documents(spark, no_docs):
    assert even(placed_in(spark, [], 50, 7), 7)
    assert label_shards.propagate(no_docs, "doc_id", spark.createDataFrame([], "doc_id long, key string"), 4).collect() == []


def test_exchanges_keep_sizes():
    movers, fillers = label_shards.exchanges({(0, 1): 10, (1, 0): 4, (2, 0): 3}, {0: 2, 1: 5, 2: 0}, 3)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert movers[i, j] + fillers.get((i, j), 0) == movers[j, i] + fillers.get((j, i), 0)
    assert movers[0, 1] == 9 and movers[1, 0] == 4 and fillers[1, 0] == 5 and movers[2, 0] == 2


def test_schema_has_clashing_names():
    assert {"row", "kept", "doc", "sha", "score", "length"} <= {c.split()[0] for c in SCHEMA.split(", ")}


# --- near copies by similarity --------------------------------------------------------------------


def jaccard_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def altered_texts():
    """Texts with copies in which some of the words are others, between 0 and a tenth of them."""
    rng = random.Random(6)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(1 + len(copy) // 20)):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def test_near_copies_by_similarity(spark, no_docs):
    texts = list(dict.fromkeys(altered_texts()))
    sets = [jaccard_shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    far = [p for p in pairs if (plain_print(texts[p[0]]) ^ plain_print(texts[p[1]])).bit_count() > 3]
    assert len(far) > len(pairs) / 5
    want = roots(range(len(texts)), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part_bytes in (jaccard_links.PART_BYTES, 300):
        found = {r.node: r.root for r in jaccard_links.near_copies(docs, "doc_id", part_bytes).collect()}
        assert {i: found.get(i, i) for i in want} == want
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()}
    assert kept == set(want.values())
    assert jaccard_links.near_copies(no_docs.select(F.col("doc_id").alias("node"), "text")).collect() == []


def test_hot_copies_are_compared_in_parts(spark, monkeypatch):
    """A text that most rows share is compared in groups; the result is the same, also where digests meet by chance."""
    monkeypatch.setattr(stream_dedup, "SALT_ROWS", 7)
    rows = [(i, "hot" if i % 3 else f"text {i % 10}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n in (0, 1000):
        assert outcome(stream_dedup.dedup(docs, ["doc_id"], broadcast_keys=n)) == expected_copies(rows)
    weak = stream_dedup.dedup(docs, ["doc_id"], digest=lambda sha: F.substring(sha, 1, 0), broadcast_keys=0)
    assert outcome(weak) == expected_copies(rows)


def plain_bits(body):
    """A five-word fingerprint, bit by bit."""
    words = body.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_blocks_and_slices_change_nothing(monkeypatch):
    bodies = [b"", b" ", b"one", b"a b c d e", b"a b c d e f", b" ".join(b"%d" % (i * i % 97) for i in range(400)), b"x" * 90 + b" y z"]
    want = [plain_bits(b) for b in bodies]
    for block, size in ((1 << 20, 1 << 16), (1, 1), (7, 3), (64, 50)):
        monkeypatch.setattr(simhash_bktree, "SLICE", size)
        monkeypatch.setattr(simhash_bktree.word_blocks, "__defaults__", (block,))
        assert fingerprints(bodies, 5).tolist() == want


def test_groups_of_near_copies_in_parts(spark):
    """Two hundred variants of two texts that share half of their words, in parts of a few texts: the same links as at once."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(10_000)}" for _ in range(120)]
    other = base[:60] + [f"v{draw.randrange(10_000)}" for _ in range(60)]
    texts = []
    for i in range(200):
        words = list(base if i % 3 else other)
        for _ in range(draw.randrange(5)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10_000)}"
        texts.append(" ".join(words))
    sets = [jaccard_shingles(t) for t in texts]
    pairs = [(a, b) for a in range(200) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = roots(range(200), pairs)
    linked_nodes = {x for p in pairs for x in p}
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    for part_bytes in (1 << 20, 4_000):
        found = {r.node: r.root for r in jaccard_links.near_copies(docs, part_bytes=part_bytes).collect()}
        assert {**{n: n for n in linked_nodes}, **found} == {n: want[n] for n in linked_nodes}


def test_turns_read_what_stands_for_others(spark, monkeypatch):
    """However many turns a group of near copies takes, the whole table is read for the first one and for the last comparison only."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    given = []

    def spied(table, *more, decide=jaccard_links.decided):
        given.append((table is docs, table.count()))
        return decide(table, *more)

    monkeypatch.setattr(jaccard_links, "decided", spied)
    found = {r.node: r.root for r in jaccard_links.near_copies(docs, part_bytes=2_000).collect()}
    assert found == {i: 0 for i in range(1, len(texts))}
    assert len(given) > 3 and sum(whole for whole, _ in given) <= 2
    assert all(rows < len(texts) for whole, rows in given if not whole)
