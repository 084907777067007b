"""Arrays read in pieces give what reading each file whole gives, wherever files are cut."""

import json
import random

import pytest

from pagesift.sources import arrays, files

ENTRIES = [
    {"query": 'a "}]{[" b', "urls": ["u1", "u2"]},
    {"urls": [], "query": "none"},
    {"query": "x\\", "urls": ["http://h/\\\"}", "}"], "more": {"deep": [{"er": "]"}, [[]]]}},
    {},
    {"query": "é ", "urls": ["ü", None], "chunk": None},
    {"query": "last}", "urls": ["{", "z"] * 5},
]

BAD = [
    '[{"query":"a","urls":["u"]}]}', '[{"query":"a","urls":["u"]}', '[{"query":"a","urls":["u"]},]', '[{"query":"a"}{"query":"b"}]',
    '[{"query":"a"},1,{"query":"b"}]', '[null]', '[1]', '{"query":"a"}x', '[{"query":"a"}] x', '[{"query":"a"}]]', '[{"query":"a"]}', "[{'query':'a'}]",
    '[{"query":"a"},[{"query":"b"}]]', '[{"urls":"no list"}]', ']', '[', '"}', '[{}][{}]', '[{"query":"a}]', '[{}]{}', '[{]}', '[{"a":1\\}]', ',{"query":"a"}]',
]

GOOD = ["[]", " [ \n] ", "[{}]", '\n[ {"query" : "a", "urls":["u"] }\n ,\n{"query":"b","urls":["v}"]}\n]\n\n']


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, str(v)) for n, v in zip(names, (size, 1))]
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def rows(df):
    return sorted((r.file.rsplit("/", 1)[-1], r.pos, r.query, r.url) for r in df.collect())


@pytest.mark.parametrize("size", [64, 1 << 27])
def test_same_as_whole_files(spark, tmp_path, small_splits, size):
    pick = random.Random(size)
    texts = [*BAD, *GOOD]
    for i in range(4):
        some = pick.choices(ENTRIES, k=pick.randint(1, 12))
        texts.append(json.dumps(some, ensure_ascii=i % 2 == 0, indent=[None, 1][i // 2]))
    whole = texts[-1]
    texts += [whole[: pick.randrange(len(whole))] for _ in range(3)]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, content in enumerate(texts):
        (folder / f"{i:03}.json").write_text(content, encoding="UTF-8")
    (folder / "empty.json").write_text("")
    (folder / "old.report.json").write_text("[{}]")
    expected = rows(files.read_results(spark, str(folder), encoding="UTF-8"))
    rejected = {r.file.rsplit("/", 1)[-1] for r in files.rejected_results(spark, str(folder)).collect()}
    small_splits(size)
    assert rows(arrays.read_result_arrays(spark, str(folder), "UTF-8")) == expected
    bad = {r.file.rsplit("/", 1)[-1] for r in arrays.parse_arrays(spark, str(folder), "UTF-8")[1].collect()}
    # a lone object counts as one line of a saved search there, and as another root here
    assert bad == rejected
    assert len(expected) > 20 and len(bad) >= len(BAD)


def test_a_large_array_is_many_tasks(spark, tmp_path, small_splits):
    entries = [{"query": f"q{i % 7}}}", "urls": [f"http://h/{i}", "]"]} for i in range(5000)]
    (tmp_path / "large.json").write_text(json.dumps(entries))
    small_splits(16 << 10)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    found = arrays.read_result_arrays(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.query, r.url) for r in found] == [(e["query"], u) for e in entries for u in e["urls"]]
    entries[4321] = {"urls": 5}
    (tmp_path / "large.json").write_text(json.dumps(entries))
    assert arrays.read_result_arrays(spark, str(tmp_path)).isEmpty()


def test_encoding_that_moves_braces(spark, tmp_path):
    with pytest.raises(ValueError, match="UTF-16"):
        arrays.read_result_arrays(spark, str(tmp_path), "UTF-16")
