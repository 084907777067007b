import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions import patterns
from pagesift.functions.patterns import PatternError
from pagesift.operators.extract import extract_matches, extract_results
from pagesift.sources.social import social_template
from pagesift.sources.templates import entries_of

SAMPLE = """<a href="https://t.me/share/url?x">s</a> https://T.ME/JohnDoe. <a href="https://t.me/share"> t.me/sharex
discord.gg/invite/abc discord.com/invite/Zed. youtube.com/c/foo youtube.com/channel/UC1
https://twitter.com/home https://twitter.com/jack https://pic.twitter.com/zz x.com/en/search?q https://netflix.com/title X.com/Élan
facebook.com/sharer/x facebook.com/zuck. instagram.com/p/abc instagram.com/nasa tiktok.com/@a.b vt.tiktok.com/@no linkedin.com/company/a&b linkedin.com/in/é-name"""

GOLDEN = {
    "telegram": ["T.ME/JohnDoe", "t.me/sharex"],
    "discord": ["discord.gg/invite/abc", "discord.com/invite/Zed"],
    "youtube": ["youtube.com/c/foo", "youtube.com/channel/UC1"],
    "twitter": [".com/home", ".com/jack", ".com/title", ".com/Élan"],
    "facebook": ["facebook.com/zuck"],
    "instagram": ["instagram.com/nasa"],
    "tiktok": ["tiktok.com/@a.b"],
    "linkedin-company": ["linkedin.com/company/a&b"],
    "linkedin-user": ["linkedin.com/in/é-name"],
}


def test_social_patterns_on_the_golden_sample(spark):
    pages = spark.createDataFrame([("p", SAMPLE)], "url STRING, text STRING")
    found: dict[str, list[str]] = {}
    for row in extract_matches(pages, social_template(), ["url"]).orderBy("ord", "pos").collect():
        found.setdefault(row.key, []).append(row.value)
    assert found == GOLDEN


def test_social_patterns_pass_the_check(spark):
    template = social_template()
    patterns.check_patterns(spark, [p for e in template for p in (e.extract, e.validate)])


@pytest.mark.parametrize(
    ("pattern", "groups"),
    [("abc", 0), ("a(b)c", 1), (r"a\(b", 0), ("[(]a", 0), ("(?:a)(?=b)(?<!c)", 0), ("(?<n>a)(b)", 2), ("[]()]a", 0)],
)
def test_group_count(pattern, groups):
    assert patterns.group_count(pattern) == groups


def test_more_than_one_group_is_refused():
    with pytest.raises(PatternError, match="more than one"):
        patterns.group_index("(a)(b)")


@pytest.mark.parametrize(
    "pattern",
    ["(?P=n)", "(?P<n>a)(?P<m>b)", "[[:alpha:]]", "[a--b]", "[a[:b:]", r"a\Kb", "(?R)", "(?|a)", "(?V1)a", "(a", "e{<=1}"],
)
def test_bad_patterns_are_refused(spark, pattern):
    with pytest.raises(PatternError):
        patterns.check_patterns(spark, ["ok", pattern])


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        (r"t\.me\/(?:a|b)", ("t.me/", "t.me/")),
        (r"(?<=(?<!p\.)ab|x)\.com\/[a-z]+", (".com/", ".com/")),
        ("abc|abd", ("", "")),
        ("(?:abc|abd)efgh", ("", "efgh")),
        ("(?:abc)?efgh", ("", "efgh")),
        ("abcd?", ("abc", "abc")),
        ("ab{2}cd", ("a", "cd")),
        ("[0-9]{1,3}abc", ("", "abc")),
        ("abc+d", ("abc", "abc")),
        ("(?i)abcd", ("", "")),
        (r"\Qabcd\E", ("", "")),
        (r"abc\d+def", ("abc", "abc")),
        ("discord", ("discord", "cord")),
        ("^abc$", ("abc", "abc")),
        ("ab", ("ab", "ab")),
        ("[a-z]+@[a-z]+", ("", "@")),
        ("k", ("k", "")),
    ],
)
def test_literals(pattern, expected):
    assert patterns.literals(pattern) == expected


def _all_matches(spark, pattern, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").withColumn("low", F.lower("t"))
    found = patterns.find_all(F.col("t"), F.col("low"), pattern)
    return [row[1] for row in df.select("i", found).orderBy("i").collect()]


#: characters that fold to ASCII letters are among them
_ALPHABET = "tT.meME/xXcom kKiIsSıİſK\n\"<ÉéßàA1"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=_ALPHABET, max_size=40), min_size=1, max_size=20))
def test_shortcuts_change_no_match(spark, texts):
    """With and without the literal shortcuts, Java finds the same."""
    texts += [t + "t.me/x" + t for t in texts[:5]] + [t + "KİS.com/" for t in texts[:3]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for pattern in (r"t\.me\/\w+", r"(?<=x|(?<!t)m)\.com\/", "kis.com", r"tik\.me|x", r"(\w)\.com"):
        index = patterns.group_index(pattern)
        plain = F.regexp_extract_all("t", F.lit(patterns.flagged(pattern)), F.lit(index))
        expected = [row[1] for row in df.select("i", plain).orderBy("i").collect()]
        assert _all_matches(spark, pattern, texts) == expected


_ATOMS = st.sampled_from([
    "ab", "t.me", "x", r"\.", r"\x40", r"\x61b", r"\x{41}", r"\u0042", r"\0101b", r"\014", r"\cAb", r"\pLb", r"\p{Lu}m", r"\PLb", r"\N{LATIN SMALL LETTER B}",
    r"\Qa.b\E", r"\d", r"\w", r"\x20", r"k\x2e", "[a-c]", r"[\x41-\x43]m", r"[^]a]", "(?:ab|me)", "(?:t)", "b?", "m+", "a{2}", r"\/", "@", r"\bm", "e",
])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(_ATOMS, min_size=1, max_size=4).map("".join), min_size=25, max_size=25), st.lists(st.text(alphabet="abABmMtTeExX .@/k\x01\f0", max_size=30), min_size=40, max_size=40))
def test_shortcuts_change_no_match_of_generated_patterns(spark, generated, texts):
    texts += ["".join(p) for p in ("write to mail@example.com", "ab t.me A.B@b", "mmb k.ab \x01b", "not found a.b Bm xme")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").withColumn("low", F.lower("t"))
    plain = [F.regexp_extract_all("t", F.lit(patterns.flagged(p)), F.lit(0)) for p in generated]
    short = [patterns.find_all(F.col("t"), F.col("low"), p) for p in generated]
    held = [patterns.contains_match(F.col("t"), F.col("low"), p) for p in generated]
    rows = df.select(F.array(*plain).alias("plain"), F.array(*short).alias("short"), F.array(*held).alias("held")).collect()
    for i, pattern in enumerate(generated):
        assert [r.short[i] for r in rows] == [r.plain[i] for r in rows], pattern
        assert [r.held[i] for r in rows] == [bool(r.plain[i]) for r in rows], pattern


@pytest.mark.parametrize(
    ("pattern", "text"),
    [
        (r"mail\x40example\.com", "write to mail@example.com"), (r"k\x2eb", "k.b"), (r"not\x20found", "not found"),
        (r"(?P<one_name>a)b", "xab"), (r"(?P<q>[\"'])x(?P=q)", "'x' \"x'"), (r"b\Z", "b\nb"), (r"b\Z", "b\n"), (r"[\Z]?b", "b"),
    ],
)
def test_python_spelling(spark, pattern, text):
    patterns.check_patterns(spark, [pattern]) if r"[\Z]" not in pattern else None
    if r"[\Z]" not in pattern:
        assert _all_matches(spark, pattern, [text]) == [regex.findall(pattern, text, flags=regex.MULTILINE | regex.IGNORECASE)]


def test_dialect_equals_the_python_module(spark):
    texts = ["a.b\nc.D  é", "É x\r\ny", "", "line1\nline2", "ΑΒΓ αβγ", "under_score 12٣"]
    for pattern in (r"^\w+", r"\w$", r"[é]", r".+", r"\d+", r"\bx", r"(\w)\s"):
        expected = [regex.findall(pattern, t, flags=regex.MULTILINE | regex.IGNORECASE) for t in texts]
        assert _all_matches(spark, pattern, texts) == expected, pattern


def test_many_patterns_share_one_automaton(spark):
    """Five hundred patterns find the same with a test of each literal, with one automaton, and with no shortcut but the pattern; literals overlap."""
    words = [f"w{i}.com" for i in range(0, 480)] + ["com/w", ".com", "w1", "1.com/", "om"] + [f"x{i}" for i in range(14)]
    template = entries_of({f"k{i}": {"extract": rf"{w.replace('.', chr(92) + '.')}\/?\d*"} for i, w in enumerate(words)} | {"any": {"extract": r"\d+"}})
    texts = [(i, f"see W{i * 7}.COM/{i} or w{i}.com/12 x{i % 30} com/w{i}") for i in range(60)] + [(100, ""), (101, None), (102, "w1.com")]
    df = spark.createDataFrame(texts, "i INT, text STRING")
    one, each = (sorted(map(tuple, extract_matches(df, template, ["i"], many=n).collect())) for n in (0, 10_000))
    assert one == each and len(one) > 300
    plain = F.regexp_extract_all("text", F.lit(patterns.flagged(r"w1\.com\/?\d*")), F.lit(0))
    assert [r.value for r in extract_matches(df, template, ["i"], many=0).where("key = 'k1'").orderBy("i").collect()] == [
        v for r in df.select("i", plain.alias("v")).orderBy("i").collect() for v in r.v or []
    ]
    whole, alone = (sorted((r.i, sorted(r.results.items())) for r in extract_results(df, template, ["i"], ["see"], many=n).collect()) for n in (0, 10_000))
    assert whole == alone
