"""Readers and writers, joins with hot templates and long targets, and reply lines that do not fit."""

from folioscan.operators import model_io
from folioscan.operators import similarity as S
from folioscan.sources import documents as D

CHAPTERS = "doc_id long, seq int, title string, level int, content string, position int"


def test_pages_of_every_format(spark, tmp_path):
    pages = spark.createDataFrame([("http://a/1", "<p>x</p>"), ("http://a/2", "<p>y, \"z\"</p>")], "url string, html string")
    want = {(r.url, r.html) for r in pages.collect()}
    for fmt in ("parquet", "json"):
        D.write_result(pages, f"{tmp_path}/{fmt}", fmt=fmt)
        assert {(r.url, r.html) for r in D.read_pages(spark, f"{tmp_path}/{fmt}", fmt).collect()} == want
    pages.write.options(header=True, escape='"').csv(f"{tmp_path}/csv")
    assert {r.url for r in D.read_pages(spark, f"{tmp_path}/csv", "csv").collect()} == {u for u, _ in want}
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "one.html").write_text("<p>two\nlines</p>")
    assert [(r.url.endswith("one.html"), r.html) for r in D.read_pages(spark, f"{tmp_path}/text", "text").collect()] == [(True, "<p>two\nlines</p>")]


def test_results_by_partition(spark, tmp_path):
    D.write_result(spark.createDataFrame([(1, "a"), (2, "b")], "n int, site string"), f"{tmp_path}/out", ["site"])
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.is_dir()) == ["site=a", "site=b"]


def test_scores_do_not_depend_on_blocks_and_salts(spark):
    rows = [(d, i, f"{i}. title {i % 4} of {d}", 1 + i % 3, f"some words {i} {i % 5} here", i) for d, n in ((1, 6), (2, 9), (3, 1)) for i in range(n)]
    ch = spark.createDataFrame(rows, CHAPTERS)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 9), (4, 9, 2)], "pair_id long, template_doc_id long, target_doc_id long")
    got = [sorted(map(tuple, S.pair_scores(pairs, ch, block=b).collect())) for b in (1, 4, 1024)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 6 * 9 + 6 * 1
    assert {r.pair_id for r in S.with_template(pairs, ch.select("doc_id", "seq"), 3, keep=True).collect()} == {1, 2, 3, 4}


def test_hot_templates_are_dealt_and_others_sent_once(spark):
    pairs = spark.createDataFrame([(i, 1 if i < 900 else i, 5000 + i) for i in range(1000)], "pair_id long, template_doc_id long, target_doc_id long")
    rows = spark.createDataFrame([(d, i) for d in (1, *range(900, 990), 4000) for i in range(3)], "doc_id long, seq int")
    for least in (100, 10_000):  # one hot template, and none
        found = S.with_template(pairs, rows, 8, least=least)
        assert sorted((r.pair_id, r.seq) for r in found.collect()) == [(i, k) for i in range(990) for k in range(3)]
        kept = S.with_template(pairs, rows, 8, keep=True, least=least)
        assert kept.count() == 990 * 3 + 10


def test_score_lines_end_at_a_score_that_is_no_number(spark):
    said = "T1-G1: 0.9 | 原因：early\n SIMILARITY_MATRIX: \n  T1-G1: 2 | 原因： a b \nT3-G1: 0.5 | 原因：out\nT2-G2: 0.4\nT2-G1: 1.2.3 | 原因：bad\nT1-G2: 0.5 | 原因：late"
    replies = spark.createDataFrame([(1, 2, 2, said), (2, 2, 2, "T1-G1: 0.9 | 原因：no marker"), (3, 2, 2, None)], "request_id long, n_t int, n_g int, text string")
    assert [tuple(r) for r in model_io.parse_score_lines(replies).collect()] == [(1, 1, 1, 1.0, "a b")]
