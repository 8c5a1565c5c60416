"""Rules and rule files, checked readers, answers over runs, reply lines, long texts and nested pages."""

import gc
import json
import random
import re
import time

import pyarrow as pa
import pytest
from oracle import differences
from pyspark.sql import functions as F

from folioscan.jobs.queries import ORACLE_SQL, QUERIES
from folioscan.operators import assemble, html, model_io, report, rules, structure
from folioscan.operators import outline as O
from folioscan.sources import documents as D

CHAPTERS = "doc_id long, seq int, title string, level int, content string"


def test_literals_are_in_every_match():
    r = random.Random(7)
    atoms = ["a", "b", "ab", r"\.", r"\d", "[a-c]", "[^]b]", "(ab)", "(a|b)", "(a[)]b)", ".", "x{2}", "a{1,2}", "b{x}", "b?", "a*", "a+", "ab+", "^", "$", r"\\", "a|b", r"\bab", r"(?:ab)", r"\x61", "[]a]", "[\\]]"]
    for _ in range(4000):
        pattern = "".join(r.choice(atoms) for _ in range(r.randrange(1, 6)))
        try:
            found = re.compile(pattern)
        except re.error:
            continue
        word = rules.required_literal(pattern)
        for _ in range(6):
            text = "".join(r.choice("abxc.]\\1 {}") for _ in range(r.randrange(14)))
            if word and (m := found.search(text)):
                assert word in m.group(), (pattern, word, text)
    assert rules.required_literal("[0-9]+ Euro(s)?") == " Euro" and rules.required_literal("a|bc") == rules.required_literal("(?i)abc") == ""


def test_many_rules_in_one_pass_and_broken_ones(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(10_000)]
    own = [(f"r{i}", rf"{w}[0-9]?\b", "info") for i, w in enumerate(words)] + [("any", "^z|q$", None), ("open", "[", "info"), ("none", None, "info")]
    texts = [None, "", "q"] + [" ".join(r.choice(words) for _ in range(30)) for _ in range(60)]
    ch = spark.createDataFrame([(1, i, "", 1, t) for i, t in enumerate(texts)], CHAPTERS)
    table = spark.createDataFrame(own, "name string, pattern string, severity string")
    got = {(x.seq, x.rule, x.severity) for x in rules.regex_rule_violations(ch, table).collect()}
    want = {(i, n, s or "warning") for i, t in enumerate(texts) if t is not None for n, p, s in own[:-2] if (p.startswith("^") or p[:5] in t) and re.search(p, t)}
    assert got == want and (2, "any", "warning") in got
    assert sorted(x.name for x in rules.broken_rules(table).collect()) == ["none", "open"]
    assert "NestedLoop" not in rules.regex_rule_violations(ch, table)._jdf.queryExecution().executedPlan().toString()


def test_rules_of_a_file_reach_the_report(spark, tmp_path):
    given = {"rules": {"t": [rules.TITLE_RULE, "own"], "s": [rules.LEVEL_RULE], "none": None}, "severity_levels": {"critical": [rules.LEVEL_RULE], "fatal": ["own"]}}
    (tmp_path / "r.json").write_text(json.dumps(given, ensure_ascii=False), encoding="utf-8")
    own, severity = rules.read_rules(spark, f"{tmp_path}/r.json")
    assert sorted(map(tuple, own.collect())) == sorted([(rules.TITLE_RULE, "t"), ("own", "t"), (rules.LEVEL_RULE, "s")])
    by = {(x.category, x.severity): x.n_rules for x in rules.rules_summary(own, severity).collect()}
    assert by == {("t", "warning"): 1, ("t", "fatal"): 1, ("s", "critical"): 1}
    ch = spark.createDataFrame([(1, 0, " ", 5, ""), (1, 1, "a", 1, "")], CHAPTERS)
    found = rules.with_severity(rules.title_violations(ch), severity)
    results = rules.content_results(ch, found)
    assert results.select("n_violations", "n_critical", "n_warning").first() == (2, 1, 1)
    pairs = spark.createDataFrame([(9, 1, 1)], "pair_id long, template_doc_id long, target_doc_id long")
    row = report.report(pairs, None, results, O.build_outline(ch), own.count()).first()
    assert (row.total_checks, row.total_issues, row.n_critical) == (6, 2, 1)
    for text in ("[1]", '{"rules": {"a": "x"}}', '{"rules": []}  '):
        (tmp_path / "bad.json").write_text(text)
        if text.startswith('{"rules": []'):
            assert rules.read_rules(spark, f"{tmp_path}/bad.json")[0].count() == 0
        else:
            with pytest.raises(ValueError):
                rules.read_rules(spark, f"{tmp_path}/bad.json")


def test_yaml_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("rules:\n  text_rules:\n    - one\n    - two\nseverity_levels:\n  info:\n    - two\n")
    own, severity = rules.read_rules(spark, f"{tmp_path}/r.yaml")
    assert {x.rule: x.severity for x in rules.with_severity(own, severity).collect()} == {"one": "warning", "two": "info"}


def test_pages_and_rejects_of_every_format(spark, tmp_path):
    rows = [("http://a/1", '<p class="x">one\ntwo</p>'), ("http://a/2", "a,b;\"\" 'c'\r\n\n\"d"), ("http://a/3", ""), ("http://a/4", "ü\\n\\\"")]
    pages = spark.createDataFrame(rows, "url string, html string")
    for fmt in ("parquet", "json", "csv"):
        D.write_result(pages, f"{tmp_path}/{fmt}", fmt=fmt)
        got = {r.url: r.html for r in D.read_pages(spark, f"{tmp_path}/{fmt}", fmt).collect()}
        assert got == dict(rows), fmt
    (tmp_path / "lines.json").write_text('{"url": "u1", "html": "<p>"}\n{"url": "u2", "html"\n{"html": "x"}\n{"url": "u3"}\n{"url": "u4", "html": "y", "more": 1}\n')
    records = D.read_checked(spark, f"{tmp_path}/lines.json", "json")
    assert sorted(r.url for r in records.filter("reason is null").collect()) == ["u1", "u4"]
    assert sorted(r.reason for r in D.rejected(records).collect()) == sorted([D.BROKEN, D.NO_URL, D.NO_HTML])
    assert D.rejected(records).filter(F.col("reason") == D.BROKEN).first().record.startswith('{"url": "u2"')
    counts = D.load_counts(records).first()
    assert (counts.n_pages, counts.n_broken, counts.n_without_url, counts.n_without_html) == (2, 1, 1, 1)


def test_answers_are_asked_once(spark, tmp_path):
    kept = model_io.Answers(spark, f"{tmp_path}/answers")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None), (None, None), ("c", "d")], "title1 string, title2 string")
    assert kept.to_ask(pairs).count() == 4 and kept.rows().count() == 0
    answers = "title1 string, title2 string, score double, reason string"
    first = spark.createDataFrame([("a", "b", 0.5, "y"), ("a", "b", 0.9, "z"), ("a", "b", 0.9, "x"), ("a", None, 0.2, None), ("e", "f", None, "no score")], answers)
    kept.save(first, "1")
    assert sorted(map(repr, kept.to_ask(pairs).collect())) == sorted(map(repr, pairs.filter("title1 is null or title1 = 'c'").collect()))
    second = spark.createDataFrame([("a", "b", 0.1, "late"), ("c", "d", 0.7, "new")], answers)
    for _ in range(2):
        kept.save(second, "2")
        kept.save(first, "1")
        got = sorted((r.title1, r.title2 or "", r.score, r.reason, r.run) for r in kept.rows().collect())
        assert got == [("a", "", 0.2, None, "1"), ("a", "b", 0.9, "x", "1"), ("c", "d", 0.7, "new", "2")]
    cells = spark.createDataFrame([(1, 0, 0, "a", "b"), (1, 0, 1, "a", None), (2, 3, 4, "a", "b"), (2, 3, 5, "x", "y")], "pair_id long, t_seq int, g_seq int, title1 string, title2 string")
    assert sorted(map(tuple, kept.scores(cells).collect())) == [(1, 0, 0, 0.9), (1, 0, 1, 0.2), (2, 3, 4, 0.9)]


def test_answers_to_what_was_asked_move_once(spark, tmp_path):
    """to_ask() deals the pairs of titles, and save() leaves them there, however many answers there are."""
    kept = model_io.Answers(spark, f"{tmp_path}/answers")
    pairs = spark.range(40).select(F.col("id").cast("string").alias("title1"), F.when(F.col("id") % 3 > 0, "b").alias("title2"))
    kept.save(kept.to_ask(pairs.filter("title1 < '2'")).withColumns({"score": F.lit(0.5), "reason": F.lit("x")}), "1")
    asked = kept.to_ask(pairs).withColumns({"score": F.lit(0.7), "reason": F.lit("y")})
    others = kept.rows().repartition(*kept.KEYS)
    plan = kept._without(asked, others, F.struct("score", "reason"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # of asked and known together, and of the others
    kept.save(asked, "2")
    assert {(r.title1, r.title2, r.run) for r in kept.rows().collect()} == {(r.title1, r.title2, "1" if r.title1 < "2" else "2") for r in pairs.collect()}


def plain_candidates(text, n):
    best = (0.0, None, None)
    try:
        for line in (text or "").split("\n"):
            if m := re.match(r"候选(\d+):\s*([\d.]+)\s*\|\s*原因：(.+)", line.strip()):
                k, score = int(m[1]) - 1, float(m[2])
                if 0 <= k < n and score > best[0]:
                    best = (score, k + 1, m[3].strip())
    except ValueError:
        pass
    return best


def test_candidate_lines(spark):
    texts = [
        "见候选2: 1.2 不对\n候选1: 0.9 | 原因：x", "候选1: 0 | 原因：x", "候选99999999999: 0.9 | 原因：x", "候选1: 0.9", "候选2: 1.5 | 原因： a \n候选1: 1.2 | 原因：b", "候选1: 0.3 | 原因：a\n候选2: 1.2.3 | 原因：b\n候选2: 0.9 | 原因：c",
        "候选0: 0.5 | 原因：a\n候选3: 0.5 | 原因：b\n 候选2:0.5|原因：c\n候选1: 0.5 | 原因：d", None, "", "候选１: ０.5 | 原因：x", "候选1: . | 原因：x",
    ]
    df = spark.createDataFrame([(i, 2, t) for i, t in enumerate(texts)], "request_id long, n_candidates int, text string")
    got = {r.request_id: (r.score, r.candidate, r.reason) for r in model_io.parse_candidates(df).collect()}
    for i, t in enumerate(texts):
        assert got.get(i, (0.0, None, None)) == plain_candidates(t, 2), t


def test_a_text_of_a_million_paragraphs(spark):
    r = random.Random(3)
    text = "\n\n".join("é" * r.randrange(6) for _ in range(1_000_000))
    began = time.time()
    parts = assemble.cut(text, 1000, "\n\n")
    assert time.time() - began < 10 and "\n\n".join(parts) == text and all(len(p.replace("\n\n", "")) <= 1000 for p in parts)
    assert assemble.cut(text, 0, "\n\n").__len__() < 1_000_000  # empty paragraphs follow one another
    rows = spark.createDataFrame([(1, 0, "T", text, 7), (1, 1, "U", None, 8), (2, 0, "V", "", 9)], "doc_id long, seq int, title string, content string, Content2 int")
    got = assemble.split_chapters(rows, 1000).groupBy("title").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()
    assert sum(x.n for x in got if x.title.startswith("T")) == len(parts) and {x.title for x in got} >= {"U", "V"}


def test_limits_from_a_column_and_images_of_parts(spark):
    image = [("u",)]
    rows = spark.createDataFrame([(1, 0, "T", "aa\n\nbb\n\ncc", 4, image), (2, 0, "S", "aa\n\nbb\n\ncc", 99, image)], "doc_id long, seq int, title string, content string, most int, images array<struct<url:string>>")
    got = sorted((x.title, x.part, x.text, len(x.images)) for x in assemble.split_chapters(rows, F.col("most")).collect())
    assert got == [("S", 0, "aa\n\nbb\n\ncc", 1), ("T (第1部分)", 1, "aa\n\nbb", 1), ("T (第2部分)", 2, "cc", 0)]


def test_one_parse_gives_all_parts(spark):
    page = '<html><head><title>A</title></head><body><h1 id="x">T</h1><p>text<img src="/a.png"></p></body></html>'
    pages = spark.createDataFrame([(1, page, "z"), (2, None, "z")], "doc_id long, html string, Html string".replace(", Html string", ", more string"))
    whole = html.parsed(pages)
    assert whole._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    row = {r.doc_id: r for r in whole.collect()}
    assert row[1].meta.title == "A" and [b.tag for b in row[1].blocks] == ["h1", "p"] and row[1].images[0].src == "/a.png" and {g.html_id or g.heading for g in row[1].regions} == {"x", "T"}
    assert row[2].blocks == [] and row[2].meta.language == "zh-CN"
    for name, one in (("blocks", html.html_blocks), ("images", html.html_images), ("regions", html.html_regions)):
        assert sorted(map(tuple, one(pages).collect()), key=repr) == sorted(((1, *x) for x in row[1][name]), key=repr)


def test_a_pair_that_was_not_compared_fails(spark):
    ch = spark.createDataFrame([(1, 0, "a", 1, ""), (2, 0, "b", 1, "")], CHAPTERS)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "pair_id long, template_doc_id long, target_doc_id long")
    verdicts = spark.createDataFrame([(1, 0, 0, 0, 1.0, True)], "pair_id long, n_missing long, n_extra long, n_issues long, similarity double, passed boolean")
    got = {r.pair_id: (r.structure_passed, r.overall_passed, r.structure_similarity) for r in report.report(pairs, verdicts, None, O.build_outline(ch)).collect()}
    assert got == {1: (True, True, 100.0), 2: (False, False, 0.0)}
    assert structure.MOST_MISSING == 3


def test_references_that_are_cut_off(spark):
    page = "<head><title>a&amp;&amp</title></head><body><h1>b&lt;&am</h1><p>&#65;&#65 &Aacute;&quo</p></body>"
    pages = spark.createDataFrame([(1, page)], "doc_id long, html string")
    assert html.parsed(pages, "meta", closed=True).first().meta.title == "a&&amp" and html.page_meta(pages).first().title == "a&&"
    assert [b.text for b in html.html_blocks(pages, closed=True).orderBy("idx").collect()] == ["b<&am", "A&#65 Á&quo"]


def test_percent_rounds_halves_up(spark):
    got = spark.createDataFrame([(0.5695,), (0.8125,), (0.56949,), (-0.0625,), (0.29,)], "s double").select(report.percent(F.col("s")))
    assert [r[0] for r in got.collect()] == [57.0, 81.3, 56.9, -6.3, 29.0]


def test_parts_leave_in_small_batches():
    page = "<body><h1>T</h1>" + "<p>x</p>" * 2000 + "</body>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([None, *[page] * 199])], ["doc_id", "html"])
    out = list(html.parts_of(batch, ("blocks", "meta")))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(200)) and max(b.num_rows for b in out) < 20
    assert [len(x) for b in out for x in b.column("blocks").to_pylist()] == [0] + [2001] * 199
    gc.collect()
    gc.disable()
    try:
        for _ in html.parts_of(batch.slice(1, 20), ("blocks", "images", "regions")):
            assert sum(isinstance(x, html._Node) for x in gc.get_objects()) <= 2003  # those of one page
    finally:
        gc.enable()


@pytest.mark.parametrize("name", ["b1_b3_pages", "b2_page_meta"])
def test_pages_that_cut_off_or_quote(spark, tmp_path, name):
    """As SQL has it, also where a title ends inside a reference or holds others."""
    page = '<html><head><title>%s</title></head><body><article><h1>%s</h1><p>a &quot;b&quot; &am</p></article></body></html>'
    rows = [(i, f"http://h{i}/x", page % (t, t)) for i, t in enumerate(["a&amp;&amp", "x &quot;y", "&amp;&am", "t &amp;lt; u"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert differences(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"), "/root/testdata/sf0.001") is None
