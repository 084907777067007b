"""Layouts to turns and back against plain Python."""

import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from pagesift.llm import chat_layouts
from pagesift.llm.queries import REGISTRY
from tests.conftest import SF

HARD = [
    "", None, "\\", "\\\\<s>", "<\\s>", "<<s>>", "</s>[INST] ok [/INST]", "[[INST]]", "<<<SYS>>", "<</SYS>", "<", "[", "é🙂\n\r\t\x00", "$0 \\1 $",
    "<<ROLE>>x<</ROLE>>y<</TURN>>", "\\<", "[\\INST]", "word " * 50_000,
]
CONTROLS = [m for marks in chat_layouts.MARKS.values() for m in marks] + list(chat_layouts.OTHER)


def plain(turns):
    """formatted_chars by counting."""

    def size(text):
        return len(text) + text.count("\\") + len(re.findall("|".join(map(re.escape, CONTROLS)), text))

    n = 0
    for role, text in turns:
        n += sum(map(len, chat_layouts.MARKS[role])) if role in chat_layouts.MARKS else sum(map(len, chat_layouts.OTHER)) + size(role)
        n += size(text)
    return n


def check(rows, found):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(by_conv) == {r.conv_id for r in found} and len(by_conv) == len(found)
    for r in found:
        turns = [t[2:] for t in sorted(by_conv[r.conv_id])]
        trained = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha256(trained.encode()).hexdigest())
        assert r.formatted_chars == plain(turns)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    mark = "</s>[INST] ok [/INST]"
    check([*rows, (-7, 0, "user", mark), (-7, 1, "assistant", mark)], REGISTRY["op12_chat_layouts"](spark, SF).collect())


def odd_rows():
    roles = ["user", "assistant", "system", "tool", None, "", "<<ROLE>>", "human", "a\nb", "\\"]
    rows = [(i % 7 if i % 7 else None, i if i % 5 else None, roles[i % len(roles)], HARD[i % len(HARD)], "x") for i in range(120)]
    rows += [(50, 1, "user", t, "x") for t in HARD] + [(60, None, "assistant", "same", "x")] * 3
    rows += [(70 + i, j, role, HARD[i % len(HARD)], "x") for i in range(20) for j, role in enumerate(["system", "user", "assistant"][i % 2 :])]
    return rows


def test_odd_conversations(spark, tmp_path):
    """Nulls in every column, control strings in texts and roles, ties, repeated rows, a column named as a result."""
    schema = "conv_id long, turn long, role string, text string, formatted string"
    at = str(tmp_path / "odd")
    (tmp_path / "odd").mkdir()
    spark.createDataFrame(odd_rows(), schema).repartition(3).write.parquet(at + "/conversations.parquet")
    mark = "</s>[INST] ok [/INST]"
    check([*(r[:4] for r in odd_rows()), (-7, 0, "user", mark), (-7, 1, "assistant", mark)], REGISTRY["op12_chat_layouts"](spark, at).collect())
    empty = spark.createDataFrame([], schema)
    assert chat_layouts.formatted(chat_layouts.canonical(chat_layouts.conversation_records(empty))).collect() == []


def test_no_control_string_is_left_in_a_text(spark):
    texts = spark.createDataFrame([(t,) for t in HARD if t is not None], "text string")
    made = texts.select("text", chat_layouts.escaped(F.col("text")).alias("e")).withColumn("back", chat_layouts.unescaped(F.col("e")))
    for r in made.collect():
        assert r.back == r.text and not any(c in r.e for c in CONTROLS)


def test_mask_covers_the_text(spark):
    rows = odd_rows()
    out = chat_layouts.formatted(chat_layouts.canonical(chat_layouts.conversation_records(spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string"))))
    for r in out.collect():
        assert sum(m.before + m.loss + m.behind for m in r["mask"]) == len(r.formatted)


JSON_LINES = [
    ('{"id": 1, "prompt": "p", "response": "r"}', "prompt", [("user", "p"), ("assistant", "r")]),
    ('{"id": 2, "prompt": "p", "completion": "c"}', "completion", [("user", "p"), ("assistant", "c")]),
    ('{"id": 3, "question": "q", "response": "r"}', "question", [("user", "q"), ("assistant", "r")]),
    ('{"id": 4, "system_prompt": "s", "question": "q", "response": ""}', "question", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ('{"id": 5, "instruction": "i", "input": "x", "output": "o"}', "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ('{"id": 6, "instruction": "i", "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"id": 7, "messages": [{"role": "user", "content": "a"}, {"role": null, "content": null}]}', "messages", [("user", "a"), ("", "")]),
    ('{"id": 8, "messages": []}', "messages", []),
    ('{"id": 9, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}', "shares",
     [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ('{"id": 10, "dialogue": {"turns": [{"speaker": "bot", "utterance": "a"}]}}', "dialogue", [("assistant", "a")]),
    ('{"id": 11, "prompt": "p"}', None, None),
    ('{"id": 12, "prompt": "p", "response": "r", "messages": [{"role": "user", "content": "a"}]}', None, None),
    ('{"id": 13}', None, None),
]


def test_layouts_of_json_files(spark, tmp_path):
    """Files of all layouts read at once; a layout is known by its nested paths, and what fits none stays."""
    (tmp_path / "lines.json").write_text("\n".join(x for x, _, _ in JSON_LINES))
    read = spark.read.json(str(tmp_path / "lines.json"))
    df = read.select("id", F.struct(*[c for c in read.columns if c != "id"]).alias("record"))
    found = {r.id: r for r in chat_layouts.canonical(df).collect()}
    for i, (_, layout, turns) in enumerate(JSON_LINES, 1):
        assert found[i].layout == layout
        assert (found[i].turns and [tuple(t) for t in found[i].turns]) == turns or found[i].turns == turns
    back = {r.id: r for r in chat_layouts.read_back(chat_layouts.formatted(chat_layouts.canonical(df))).collect()}
    assert len(back) == len(JSON_LINES)
    for i, (_, _, turns) in enumerate(JSON_LINES, 1):
        assert [tuple(t) for t in back[i].turns] == (turns or [])


def test_a_layout_is_a_row_of_a_table(spark):
    df = spark.createDataFrame([(("x", "y"),)], "record struct<ask:string,tell:string>")
    own = {"own": chat_layouts.Exchange((("user", ("ask",)), ("assistant", ("tell",))))}
    assert chat_layouts.canonical(df).first().layout is None
    assert chat_layouts.canonical(df, layouts=own).first().layout == "own"


def test_main_path_is_native(spark):
    plan = REGISTRY["op12_chat_layouts"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("python|arrow|pandas|ExistingRDD", plan, re.I)
