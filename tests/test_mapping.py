"""Mapping, outline, offsets and folds against plain loops, and small outlines worked out by hand."""

import random
from collections import Counter

from pyspark.sql import functions as F

from folioscan.operators import assemble, html, mapping, outline, renumber, sections, structure, tree_match
from folioscan.operators import similarity as S

CHAPTERS = "doc_id long, seq int, title string, level int, content string, position int"


def chapters(spark, docs):
    return spark.createDataFrame([(d, i, t, n, "", i) for d, rows in docs.items() for i, (n, t) in enumerate(rows)], CHAPTERS)


def pairs_of(spark, *rows):
    return spark.createDataFrame(rows, "pair_id long, template_doc_id long, target_doc_id long")


def missing_titles(spark, template, target, semantic="none"):
    ch, pairs = chapters(spark, {1: template, 2: target}), pairs_of(spark, (1, 1, 2))
    found = mapping.map_chapters(pairs, ch, S.pair_scores(pairs, ch, semantic))
    rows = mapping.mapping_details(pairs, ch, found).join(mapping.missing_chapters(found).select("pair_id", "t_seq"), ["pair_id", "t_seq"])
    return sorted(r.t_title for r in rows.collect())


def test_missing_chapters_of_small_outlines(spark):
    template = [(2, "2.设计任务书"), (2, "3.对外接口"), (3, "3.1 API接口"), (3, "3.2 消息接口"), (2, "4. 概要说明")]
    assert missing_titles(spark, template, [x for x in template if x[0] == 2]) == ["3.1 API接口", "3.2 消息接口"]
    template = [(1, "1. 概述"), (2, "2. 功能模块"), (3, "2.1 用户管理"), (3, "2.2 权限管理"), (3, "2.3 数据管理"), (2, "3. 技术架构")]
    assert missing_titles(spark, template, [x for x in template if x[1] != "2.2 权限管理"], "text") in (["2.2 权限管理"], ["2.3 数据管理"])


def plain_greedy(t_level, g_level, score):
    used, out = set(), {}
    for level in sorted(set(t_level)):
        for t in [i for i, x in enumerate(t_level) if x == level]:
            best, at, crossed = 0.0, None, False
            for g, x in enumerate(g_level):
                if x == level and g not in used and score[t][g] > best and score[t][g] >= 0.4:
                    best, at = score[t][g], g
            if at is None:
                free = [g for k in (level - 1, level + 1) for g, x in enumerate(g_level) if x == k and g not in used]
                free = free or [g for k in (level - 2, level + 2) if k > 0 for g, x in enumerate(g_level) if x == k and g not in used]
                for g in free:
                    if score[t][g] > best and score[t][g] >= 0.6:
                        best, at, crossed = score[t][g], g, True
            if at is not None:
                used.add(at)
            out[t] = (-1 if at is None else at, crossed)
    return out


def test_greedy_against_plain_loop():
    r = random.Random(3)
    for _ in range(400):
        t, g = ([r.randrange(1, 6) for _ in range(r.randrange(1, 9))] for _ in range(2))
        score = [[r.choice([0.1, 0.4, 0.5, 0.6, 0.6, 0.9]) for _ in g] for _ in t]
        pair, got = mapping.Greedy(Counter(g), S.CONFIG), {}
        for a in sorted(range(len(t)), key=lambda a: (t[a], a)):
            order = sorted((b for b in range(len(g)) if score[a][b] >= 0.4 and abs(t[a] - g[b]) <= 2), key=lambda b: (-score[a][b], b))
            k, crossed = pair.choose(t[a], [score[a][b] for b in order], [g[b] for b in order], order)
            got[a] = (order[k] if k >= 0 else -1, crossed)
        assert got == plain_greedy(t, g, score)


def test_outline_against_a_stack(spark):
    r = random.Random(4)
    docs = {d: [(r.randrange(1, 7), f"t{i}") for i in range(r.randrange(1, 14))] for d in range(40)}
    tree = outline.build_outline(chapters(spark, docs)).collect()
    got = {(x.doc_id, x.seq): ([a.seq for a in x.ancestors], x.path) for x in tree}
    for d, rows in docs.items():
        stack = []
        for i, (level, _) in enumerate(rows):
            while stack and rows[stack[-1]][0] >= level:
                stack.pop()
            assert got[d, i] == (stack, " > ".join(rows[k][1] for k in stack))
            stack.append(i)


def test_offsets_against_all_pairs(spark):
    r = random.Random(5)
    docs, pairs = {}, []
    for p in range(60):
        base = [r.randrange(1, 5) for _ in range(r.randrange(2, 7))]
        docs[2 * p] = [(1, f"{x} a") for x in base]
        docs[2 * p + 1] = [(1, f"{x + r.choice([1, 1, 1, 0])} a") for x in base[: r.randrange(1, 7)]]
        pairs.append((p, 2 * p, 2 * p + 1))
    ch, pr = chapters(spark, docs), pairs_of(spark, *pairs)
    got = {x.pair_id: (x.offset_value, x.confidence) for x in renumber.offset_patterns(renumber.numbered(pr, ch), share=0.2).collect()}
    for p, a, b in pairs:
        t, g = ([int(x[1].split()[0]) for x in docs[k]] for k in (a, b))
        offsets = [y - x for x in t for y in g]
        (most, n), = Counter(offsets).most_common(1)
        want = (most, n / len(offsets)) if len(g) >= 2 and n / len(offsets) >= 0.2 and most else None
        assert got.get(p) == want


def test_extra_takes_descendants_and_verdicts_of_empty_targets(spark):
    docs = {1: [(1, "概述"), (2, "前端")], 2: [(1, "概述"), (2, "后端"), (3, "库"), (1, "新章")]}
    ch, pairs = chapters(spark, docs), pairs_of(spark, (1, 1, 2), (2, 1, 3))
    assert sorted((x.pair_id, x.seq) for x in tree_match.tree_extra(pairs, outline.build_outline(ch)).collect()) == [(1, 1), (1, 2), (1, 3)]
    documents = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = {x.pair_id: x for x in structure.structure_check(documents, pairs, ch).collect()}
    assert (got[2].n_missing, got[2].n_extra, got[2].n_issues, got[2].similarity, got[2].passed) == (2, 0, 1, 0.0, False)


def test_parts_and_lines_against_plain_folds(spark):
    r = random.Random(6)
    texts = ["\n\n".join("x" * r.randrange(0, 30) for _ in range(r.randrange(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(i, 0, "T", t) for i, t in enumerate(texts)], "doc_id long, seq int, title string, content string")
    got = {}
    for x in assemble.split_chapters(df, 40).orderBy("doc_id", "part").collect():
        got.setdefault(x.doc_id, []).append(x.text)
    lines = {x.doc_id: x.t for x in df.select("doc_id", assemble.truncate_at_lines(F.col("content"), 40).alias("t")).collect()}
    for i, t in enumerate(texts):
        parts, n = [[]], 0
        for p in t.split("\n\n") if len(t) > 40 else []:
            if n + len(p) > 40 and parts[-1]:
                parts.append([])
                n = 0
            parts[-1].append(p)
            n += len(p)
        assert got[i] == (["\n\n".join(p) for p in parts] if len(t) > 40 else [t])
        if len(t) > 40:
            kept, n = [], 0
            for line in t.split("\n"):
                if n + len(line) + 1 > 40:
                    break
                kept.append(line)
                n += len(line) + 1
            assert lines[i].startswith("\n".join(kept) + "\n\n[注意")


PAGE = """<html><head><title> A &amp; B </title><meta name="Keywords" content="x, y"><script>var a = "<h1>no</h1>";</script></head><body><h1>Page</h1>
<h1 id="one">第一章 概述</h1><p>first text</p><h2>1.1 背景</h2><p>long enough text</p><h2>1.2 项目目标</h2><p>short</p><div>second <b>long text</div><h3>1.2.1 细节</h3><p>deep enough text</p><hr><p>after the rule</p>
<h1>第二章</h1><ul><li>item one is long</li></ul><h4>skip</h4><p>below the skip</p></body></html>"""


def test_page_to_chapters(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<h1>only</h1><p>text</p>")], "doc_id long, html string")
    rows = sections.page_chapters(html.html_blocks(pages)).orderBy("doc_id", "seq").collect()
    assert [(x.title, x.level, x.position, x.parent_path) for x in rows] == [
        ("第一章 概述", 1, 0, ""), ("1.1 背景", 2, 0, "第一章 概述"), ("1.2 项目目标", 2, 1, "第一章 概述"), ("1.2.1 细节", 3, 2, "第一章 概述 > 1.2 项目目标"), ("第二章", 1, 1, ""), ("skip", 4, 100, "第二章"),
    ]
    assert rows[2].content == "second long text\n\ndeep enough text" and rows[3].content == "deep enough text"
    meta = {x.doc_id: x for x in html.page_meta(pages).collect()}
    assert (meta[1].title, meta[1]["keywords"], meta[1].language) == ("A & B", ["x", "y"], "zh-CN")


def test_stream_of_chapters(spark, tmp_path):
    from folioscan.streaming import violations

    chapters(spark, {1: [(1, " "), (5, "deep")]}).write.parquet(f"{tmp_path}/in")
    violations.write_violations(violations.page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_images_of_chapters(spark):
    page = """<body><h1>P</h1><div><h1>A</h1><p>before the <b>picture</b></p><img src="/a.png" alt="x"><p>after it</p><img><div class="fig"><img src="b.png" title="t"><p>caption</p></div></div>
    <section id="s"><img src="//c/d.png"></section><h1 id="s">B</h1><p>text</p></body>"""
    pages = spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string")
    own = spark.createDataFrame([(1, 0, "A", ""), (1, 1, "B", "s"), (1, 2, "none", "")], "doc_id long, seq int, title string, html_id string")
    rows = sections.chapter_images(own, html.parsed(pages), F.lit("http://h")).orderBy("seq", "number").collect()
    assert [(x.seq, x.number, x.url, x.position) for x in rows] == [(0, 1, "http://h/a.png", "A - 图片1"), (0, 3, "http://h/b.png", "A - 图片3"), (1, 1, "http://c/d.png", "B - 图片1")]
    assert rows[0].context == "before the picture | after it" and rows[1].context == "caption | caption" and rows[1].image_title == "t"


def test_rules_inventory_and_validation(spark):
    from folioscan.operators import rules

    by = {(x.category, x.severity): x.n_rules for x in rules.rules_summary(rules.rules_df(spark), rules.severity_df(spark)).collect()}
    assert by == {("text_rules", "critical"): 1, ("text_rules", "warning"): 7, ("image_rules", "critical"): 1, ("image_rules", "warning"): 7, ("structure_rules", "warning"): 5, ("format_rules", "info"): 2, ("format_rules", "warning"): 3}
    docs = {1: [(1, f"{i} a") for i in range(1, 6)], 2: [(1, f"{i} a") for i in range(1, 5)]}
    ch, pairs = chapters(spark, docs), pairs_of(spark, (1, 1, 2))
    merged = renumber.merge_patterns(renumber.all_patterns(renumber.numbered(pairs, ch)))
    got = {x.pattern_type: x.valid for x in renumber.validate_patterns(merged, pairs, ch).collect()}
    assert got == {"deletion": False}


def test_mapping_over_many_small_batches(spark):
    """Rows of a template chapter that several batches share, chapters without scores or level, one that is there twice, and pairs without any target chapter."""
    r = random.Random(8)
    docs = {d: [(r.choice([1, 2, 2, 3, None]), f"{r.choice('abc')}") for _ in range(r.randrange(1, 12))] for d in range(1, 9)}
    ch = chapters(spark, docs)
    pairs = pairs_of(spark, *[(10 * t + g, t, g) for t in (1, 2) for g in range(3, 10)])
    scores = [(10 * t + g, i, j, n, m, r.choice([0.3, 0.45, 0.6, 0.7, 0.95]), 0.5, 0.5, 0.5, 0.5) for t in (1, 2) for g in range(3, 9) for i, (n, _) in enumerate(docs[t]) for j, (m, _) in enumerate(docs[g])]
    scores.append((777, 0, 0, 1, 1, 0.9, 0.5, 0.5, 0.5, 0.5))  # of a pair that is not asked about
    given = spark.createDataFrame(scores, "pair_id long, t_seq int, g_seq int, t_level int, g_level int, overall double, title_sim double, content_sim double, position_sim double, structure_sim double")
    want = {}
    for t in (1, 2):
        for g in range(3, 10):
            own = {(x[1], x[2]): x[5] for x in scores if x[0] == 10 * t + g}
            levels = [n for n, _ in docs[t]]
            known, places = [i for i, n in enumerate(levels) if n], [j for j, (m, _) in enumerate(docs.get(g, [])) if m]
            got = plain_greedy([levels[i] for i in known], [docs[g][j][0] for j in places], [[own[i, j] for j in places] for i in known])
            want |= {(10 * t + g, i): None for i in range(len(levels))} | {(10 * t + g, known[k]): None if at < 0 else places[at] for k, (at, _) in got.items()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("1", "3", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found = mapping.map_chapters(pairs, ch, given).collect()
            assert len(found) == len(want) and {(x.pair_id, x.t_seq): x.g_seq for x in found} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    twice = mapping.map_chapters(pairs_of(spark, (1, 1, 2)), chapters(spark, {1: [(1, "a")], 2: [(1, "a"), (1, "b")]}).union(chapters(spark, {1: [(1, "a")]})), given.limit(0).union(
        spark.createDataFrame([(1, 0, j, 1, 1, 0.9, *[0.5] * 4) for j in (0, 1)], given.schema)))
    assert sorted(x.g_seq for x in twice.collect()) == [0, 1]


def test_mapping_sends_its_rows_once(spark):
    """Scores go to the greedy step flat: they are neither gathered to lists nor joined to the template chapters."""
    ch, pairs = chapters(spark, {1: [(1, "a")], 2: [(1, "a")]}), pairs_of(spark, (1, 1, 2))
    names = "pair_id long, t_seq int, g_seq int, t_level int, g_level int, overall double, title_sim double, content_sim double, position_sim double, structure_sim double"
    scores = spark.createDataFrame([(1, 0, 0, 1, 1, *[0.9] * 5)], names)
    assert "collect_list" not in mapping.map_chapters(pairs, ch, scores)._jdf.queryExecution().optimizedPlan().toString()
