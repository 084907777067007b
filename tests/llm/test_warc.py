"""Archives: an exact round trip, and what must be refused."""

import base64
import gzip
import hashlib
import io
from collections import Counter

import pytest

from pyarrow import fs

from pagesift.llm.common import file_system, fresh_dir, whole_file
from pagesift.llm.warc_members import assigned, inflated, normalise, parsed, read_index, read_records, record, records, write_archives

PAGES = [
    (1, "http://a/", "<p>same</p>"),
    (2, "http://b/", "<p>same</p>"),
    (3, "http://c/\r\nX: y", "<p>é WARC/1.1\r\n\r\n</p>"),
    (4, None, None),
    (5, "http://d/", ""),
    (6, "http://e/", "long " * 50_000),
    (7, "http://f/", "<p>same</p>"),
    (7, "http://f/", "<p>same</p>"),
    (8, "", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    (None, "http://g/", "<p>same</p>"),
    (None, None, "alone"),
    (None, "http://h/", "twice, no id"),
    (None, "http://h/", "twice, no id"),
]


def expected():
    response = {}
    for page_id, _, html in PAGES:
        response[html or ""] = max((i for i in (page_id, response.get(html or "")) if i is not None), default=None)
    out = Counter()
    for page_id, _, html in PAGES:
        body, first = (html or "").encode(), response[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = first == page_id
        out[page_id, len(body), digest, "response" if same else "revisit", None if same else first, body if same else None] += 1
    return out


@pytest.mark.parametrize("size", [1, 300_000, 1 << 30])
def test_round_trip(spark, size):
    rows = [(*p, "x", 1, None) for p in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, size int, response string").repartition(3)
    source, target = fresh_dir(spark, "warc"), fresh_dir(spark, "warc")
    archives = write_archives(pages, source, size)
    index = normalise(archives, source, target)
    assert index.count() == len(PAGES)
    assert Counter(index.collect()) == Counter(read_index(spark, target).select(*index.columns).collect())
    got = Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
        for r in read_records(index, target).collect()
    )
    assert got == expected()


@pytest.mark.parametrize("groups", [0, 1000])
def test_responses_beyond_what_may_be_broadcast(spark, groups):
    """A payload that most pages share, with and without a broadcast of the groups."""
    rows = [*PAGES, *((100 + i, "http://hot/", "hot") for i in range(200))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = {}
    for page_id, _, html in rows:
        want[html or ""] = max((i for i in (page_id, want.get(html or "")) if i is not None), default=None)
    found = assigned(pages, groups, 50).collect()
    assert len(found) == len(rows)
    for r in found:
        first = want[bytes(r.body).decode()]
        assert r.refers_to == (None if first == r.page_id else first)


def test_a_repeated_task_replaces_its_file(spark):
    folder = fresh_dir(spark, "warc")
    for content in (b"first attempt", b"second"):
        with whole_file(folder, "part") as out:
            out.write(content)
    system, at = file_system(folder)
    assert [f.base_name for f in system.get_file_info(fs.FileSelector(at))] == ["part"]
    with system.open_input_stream(f"{at}/part") as file:
        assert file.read() == b"second"


def test_no_pages(spark):
    source, target = fresh_dir(spark, "warc"), fresh_dir(spark, "warc")
    archives = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), source)
    assert read_records(normalise(archives, source, target), target).collect() == []


def test_any_number_of_members():
    made = [record(i, f"http://x/{i}", b"body %d" % i, None) for i in range(20)]
    whole = gzip.compress(b"".join(made))
    split = b"".join(gzip.compress(b"".join(made[i : i + 3])) for i in range(0, 20, 3))
    for data in (whole, split):
        assert list(records(inflated(io.BytesIO(data)))) == made
    assert [parsed(m)["page_id"] for m in made] == list(range(20))


def test_cut_files_are_refused():
    data = gzip.compress(record(1, "http://x/", b"0123456789" * 100, None))
    with pytest.raises(EOFError):
        list(records(inflated(io.BytesIO(data[:-20]))))
    with pytest.raises(EOFError):
        list(records(inflated(io.BytesIO(gzip.compress(record(1, None, b"body", None)[:-9])))))
