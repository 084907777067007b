"""Repairs against a search over all edits, the query against the contract row by row."""

import heapq
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from pagesift.llm import turn_repair
from pagesift.llm.queries import REGISTRY
from tests.conftest import SF

GOOD = re.compile("(s?(ua)+)?")
START = re.compile("s?(ua)*u?")


def search(rows):
    """(cost, audit, repaired lines) of (role, text, fault): cheapest first, then the least letters, over whole edit strings."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, at, roles, lines = heapq.heappop(todo)
        if at == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, list(lines)
        tail = (at, "s" if roles == "s" else roles[-1:])
        if tail in done:
            continue
        done.add(tail)
        out = []
        if at < len(rows):
            role, text, fault = rows[at]
            out.append((cost + 3, audit + "D", at + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                out.append((cost + more, audit + "K", at + 1, roles + role[:1], (*lines, f"{role}:{text}")))
                out += [(cost + 2 + more, audit + "R", at + 1, roles + x[0], (*lines, f"{x}:{text}")) for x in ("user", "assistant")]
        out += [(cost + 2, audit + "I", at, roles + x[0], (*lines, x + ":")) for x in ("user", "assistant")]
        for entry in out:
            kept = len(entry[3]) - len(roles)
            if START.fullmatch(entry[3]) and (kept == 1 or entry[1][-1] == "D"):
                heapq.heappush(todo, entry)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(conv_rows):
    """What the query returns for (turn, role, text) after damage, sorted."""
    found = faults([r[1:] for r in conv_rows])
    turns = [t for t, _, _ in conv_rows if t is not None]
    cost, audit, lines = search(found)
    pairs = zip(conv_rows, conv_rows[1:])
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(sum(f[2] == kind for f in found) for kind in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost,
        audit,
        sha256("\n".join(lines).encode()).hexdigest(),
    )


def damaged(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = by_conv[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return by_conv


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(rows, found):
    by_conv = damaged(rows)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in found}
    assert len(got) == len(found) and set(got) == set(by_conv)
    for conv, own in by_conv.items():
        assert got[conv] == expected(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(rows, REGISTRY["op13_turn_repair"](spark, SF).collect())


def test_odd_conversations(spark, tmp_path):
    """Nulls in every column, blanks, repeats, unknown and empty roles, a column named as a result, conversations that lose all rows."""
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "umbra"]
    texts = ["Yes.", "No!", "why?  \n", "cut off", "", None, " \t\x0b", "é。", "...", "a.b"]
    rows = [(c, t, draw.choice(roles), draw.choice(texts)) for c in range(300) for t in draw.sample(range(12), draw.randint(1, 8))]
    rows += [(None, t, draw.choice(roles), draw.choice(texts)) for t in range(9)] + [(1000 + i, None, "user", "Hi.") for i in range(30)]
    rows += [(2000 + i, 0, "user", "One?") for i in range(60)]
    at = str(tmp_path)
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    table.repartition(3).write.parquet(at + "/conversations.parquet")
    assert any(not own for own in damaged(rows).values())
    check(rows, REGISTRY["op13_turn_repair"](spark, at).collect())
    assert turn_repair.repaired(table.limit(0)).collect() == []


def test_text_keys_and_ties(spark):
    """String ids stay strings; rows of one turn are sorted by role; a repeated row is a duplicate."""
    rows = [("x", 1, "user", "Hi."), ("x", 1, "assistant", "Yes."), ("x", 0, "system", "S."), ("x", 1, "user", "Hi.")]
    r = turn_repair.repaired(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).first()
    assert (r.conv_id, r.gaps, r.duplicate, r.illegal) == ("x", 0, 1, 2)
    assert (r.cost, r.audit) == search(faults([("system", "S."), ("assistant", "Yes."), ("user", "Hi."), ("user", "Hi.")]))[:2]


ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", ""]), st.sampled_from(["", "truncated", "blank", "duplicate"])), max_size=14)
KINDS = {"": turn_repair.FINE, "truncated": turn_repair.TRUNCATED, "duplicate": turn_repair.DUPLICATE, "blank": turn_repair.BLANK}


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_cheapest_and_least(rows):
    codes = bytes(turn_repair.INITIALS.get(role[:1], 0) * 4 + KINDS[fault] for role, fault in rows)
    assert turn_repair.repair(codes) == search([(role, "t", fault) for role, fault in rows])[:2]


def test_checkpoints_are_few():
    """The kept vectors are those that a whole backward pass has, and a long conversation keeps about its root of them."""
    draw = random.Random(3)
    codes = bytes(draw.randrange(16) for _ in range(10_000))
    block = int(len(codes) ** 0.5)
    marks, whole = turn_repair.checkpoints(codes, block), turn_repair.vectors(codes, turn_repair.END)
    assert marks == whole[:: block] if len(codes) % block == 0 else marks == [*whole[::block], whole[-1]]
    assert len(marks) <= 102
    cost, audit = turn_repair.repair(codes)
    assert cost == whole[0][0] and sum(letter != "I" for letter in audit) == len(codes)
