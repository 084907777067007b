"""Pieces, spans and decoding against the library."""

import public_tokenizers
import sentencepiece

from pagesift.llm.piece_codec import CharacterMap, Codec, aligned, codec, encode
from tests.llm.conftest import TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")


def compiled(rules: dict[bytes, bytes]) -> bytes:
    """A character map with these replacements, laid out as a double array by first fit."""
    texts, values = b"", {}
    for new in rules.values():
        values.setdefault(new, len(texts))
        texts += new + b"\0" if new not in values or values[new] == len(texts) else b""
    trie: dict = {}
    for key, new in rules.items():
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = values[new]
    units, used = {0: 0}, {0}

    def put(node: dict, at: int, label: int) -> None:
        labels = [0 if k is None else k for k in node]
        base = next(b for b in range(1, 1 << 20) if all((b ^ x) not in used for x in labels) and (at ^ b) < 1 << 21)
        used.update(base ^ x for x in labels)
        units[at] = label | (None in node) << 8 | (at ^ base) << 10
        for k, child in node.items():
            if k is None:
                units[base] = 1 << 31 | child
            else:
                put(child, base ^ k, k)

    put(trie, 0, 0)
    blob = b"".join(units.get(i, 0xFF).to_bytes(4, "little") for i in range(-(-(max(units) + 1) // 256) * 256))
    return len(blob).to_bytes(4, "little") + blob + texts


RULES = {b"A": b"a", "ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "é".encode(): "e".encode(), b"\t": b" ", "®".encode(): b""}


def field(number: int, value: bytes | int) -> bytes:
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def variant(tmp_path, name: str, **spec) -> str:
    """The model with another way to normalise."""
    numbers = {"map": 2, "prefix": 3, "squeeze": 4, "escape": 5}
    path = tmp_path / name
    own = b"".join(field(numbers[k], v) for k, v in spec.items())
    path.write_bytes(open(PATH, "rb").read() + field(3, own))  # fields given again are merged
    return str(path)


def check(made: Codec, text: str):
    want = made.model.encode(text, return_type="proto")
    got = made.encode([text.encode()])
    assert got["ids"].to_pylist()[0] == [p.id for p in want.pieces]
    assert list(zip(got["starts"].to_pylist()[0], got["ends"].to_pylist()[0])) == [(p.begin, p.end) for p in want.pieces]
    assert got["decoded"].to_pylist()[0] == made.model.decode([p.id for p in want.pieces])


ODD = [*filter(None, TEXTS), "", "  a  b ", "a ", " ▁ ", "▁", "a\x00b", "\n", "x\ny z", "   "]


def test_pieces_and_spans():
    for text in ODD:
        check(codec(PATH), text)


def test_longest_key_wins_and_sources_are_kept():
    made, source = aligned("zabcab®é!".encode(), CharacterMap(compiled(RULES)))
    assert made.tobytes() == b"zYZXe!"
    assert source.tolist() == [0, 1, 1, 4, 8, 10]


def test_character_map_and_spaces(tmp_path):
    for i, spec in enumerate(({"map": compiled(RULES)}, {"map": compiled(RULES), "squeeze": 1}, {"squeeze": 1}, {"prefix": 0}, {"prefix": 0, "squeeze": 1})):
        path = variant(tmp_path, f"m{i}", **spec)
        made = Codec(path)
        for text in [*ODD, "abcab ﬁ AB é\té®", "®", " ® ", "ab" * 50, "\t a  \t", "é" * 9 + "  "]:
            assert made.normalized(text.encode())[0].tobytes().decode() == made.model.normalize(text), (spec, text)
            check(made, text)


def test_words_remembered_give_the_same_ids():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    long = TEXTS[9]
    for _ in range(2):
        assert codec(PATH).ids(long).tolist() == model.encode(long)


def test_table(odd_docs, no_docs):
    found = encode(odd_docs, ["doc_id", "kept", "row"], PATH).collect()
    assert len(found) == odd_docs.count()
    for r in found:
        text = TEXTS[r.doc_id if r.doc_id < 100 else 10] or ""
        assert r.ids == codec(PATH).model.encode(text) and len(r.starts) == len(r.ends) == len(r.ids)
        assert not r.ids or (r.starts[0], r.ends[-1]) == (0, len(text.encode()))
    assert encode(no_docs, ["doc_id"], PATH).collect() == []
