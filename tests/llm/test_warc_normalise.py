import gzip

import pytest

from folioscan.llm import warc_normalise as N
from folioscan.llm.common import table

SCHEMA = "page_id long, url string, html string, first string, payload string"


def plain(rows, least=0):
    out = []
    for p, _, h, *_ in rows:
        raw = (h or "").encode()
        same = [q for q, _, g, *_ in rows if (g or "").encode() == raw and q is not None]
        first = min(same, default=None) if len(raw) >= least else None
        revisit = first is not None and p != first
        out.append((p, len(raw), N.digest_of(raw), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [(3, "http://x/\r\nEvil: 1", "<p>a</p>"), (1, None, "<p>a</p>"), (1, "u", "<p>a</p>"), (2, "", None), (4, "", ""), (None, "é", "<p>a</p>"), (None, "", "zz"), (None, "", "zz"), (9, "u", "x\r\n\r\nWARC/1.1 é" * 30_000), (8, "u", "tiny"), (7, "u", "tiny")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_against_plain_form(spark, tmp_path, least):
    rows = [(*r, "", "") for r in ROWS]
    found = N.round_trip(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}", least, archive_bytes=100)
    assert rows_of(found) == plain(rows, least)
    assert all(r.intact for r in found.collect())
    whole = sum(gzip.decompress(p.read_bytes()).count(b"WARC-Record-ID") for p in tmp_path.glob("members/*.gz"))
    assert whole == len(rows)


def test_each_member_stands_alone(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    names = N.write_archives(pages, str(tmp_path / "a"))
    done = N.normalise(names, str(tmp_path / "b")).collect()
    assert sum(d.records for d in done) == pages.count()
    for d in done:
        raw = open(d.archive, "rb").read()
        for line in open(d.idx).read().splitlines():
            offset, length = map(int, line.split("\t")[:2])
            assert gzip.decompress(raw[offset : offset + length]).startswith(b"WARC/1.1\r\n")


def test_test_table_and_empty(spark, sf):
    pages = table(spark, sf, "pages")
    assert rows_of(N.round_trip(pages)) == plain([(p.page_id, p.url, p.html) for p in pages.collect()])
    assert N.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
