import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folioscan.operators import mapping
from folioscan.operators import similarity as S

CHAPTERS = "doc_id long, seq int, title string, level int, content string, position int"
PAIRS = "pair_id long, template_doc_id long, target_doc_id long"


def table(spark, seed, sizes):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "概述", "系统", "ab", "abc", "x"] + [f"rare{i}" for i in range(60)]
    text = lambda most: " ".join(r.choice(words) for _ in range(r.randrange(most)))
    rows = [(d, i, r.choice(["", f"{i}. ", "1.2 "]) + text(5), r.randrange(0, 8), text(9), r.choice([i, i, 100 * i + 1, 0])) for d, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, CHAPTERS)


@pytest.mark.parametrize(("semantic", "dense"), [("text", 0), ("none", 150), ("given", 0)])
def test_no_strong_cell_is_lost(spark, semantic, dense):
    ch = table(spark, 5, {1: 30, 2: 45, 3: 4, 4: 1, 5: 0, 6: 200})
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 4, 2), (4, 1, 6), (5, 3, 5), (6, 5, 3), (7, 6, 1)], PAIRS)
    if semantic == "given":
        semantic = S.pair_scores(pairs, ch, "none").filter((F.col("t_seq") + F.col("g_seq")) % 7 == 0).select("pair_id", "t_seq", "g_seq", (F.col("t_seq") % 10 / 8).alias("score"))
    want = sorted(map(tuple, S.pair_scores(pairs, ch, semantic).filter(S.is_strong()).collect()))
    got = sorted(map(tuple, S.strong_scores(pairs, ch, semantic, dense=dense).select(S.pair_scores(pairs, ch).columns).collect()))
    assert got == want and len(want) > 100


def test_far_targets_make_few_cells(spark):
    rows = [(1, i, f"part {i} one", 1 + i % 3, f"word{i} text{i}", i) for i in range(12)] + [(2, i, f"other {i} two", 1 + i % 3, f"body{i} more{i}", i) for i in range(3000)]
    ch, pairs = spark.createDataFrame(rows, CHAPTERS), spark.createDataFrame([(1, 1, 2)], PAIRS)
    assert S.candidates(pairs, ch).count() < 0.05 * 12 * 3000
    assert sorted(map(tuple, S.strong_scores(pairs, ch, dense=0).collect())) == sorted(map(tuple, S.pair_scores(pairs, ch).filter(S.is_strong()).collect()))


def test_mappings_are_the_same_from_all_cells(spark):
    ch = table(spark, 9, {d: 3 + d for d in range(25)})
    pairs = spark.createDataFrame([(d, 0, d) for d in range(1, 25)], PAIRS)  # one template serves all pairs
    want = sorted(map(tuple, mapping.map_chapters(pairs, ch, S.pair_scores(pairs, ch)).collect()))
    assert sorted(map(tuple, mapping.map_chapters(pairs, ch, S.strong_scores(pairs, ch, dense=0)).collect())) == want


def test_other_weights(spark):
    ch, pairs = table(spark, 2, {1: 20, 2: 30}), spark.createDataFrame([(1, 1, 2)], PAIRS)
    cfg = replace(S.CONFIG, similarity=0.5, title_weight=0.5, content_weight=0.2, position_weight=0.2, structure_weight=0.1)
    want = sorted(map(tuple, S.pair_scores(pairs, ch, "text", cfg).filter(S.is_strong(cfg)).collect()))
    assert sorted(map(tuple, S.strong_scores(pairs, ch, "text", cfg, dense=0).collect())) == want
    with pytest.raises(ValueError):
        S.candidates(pairs, ch, "text", replace(S.CONFIG, structure_weight=0.5))


def test_words_in_common_are_counted_once_a_cell(spark):
    ch, pairs = table(spark, 3, {1: 5, 2: 6}), spark.createDataFrame([(1, 1, 2)], PAIRS)
    plan = S.strong_scores(pairs, ch)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 2  # of titles and of contents


def test_bits_are_those_of_the_title_words_and_places_may_be_given(spark):
    ch, pairs = table(spark, 4, {1: 12, 2: 15}), spark.createDataFrame([(1, 1, 2)], PAIRS)
    known = S.features(ch)
    for r in known.collect():
        bits = 0
        for w in r.title_words:
            bits |= 1 << (w & 63)
        assert r.title_bits & (1 << 64) - 1 == bits
    want = sorted(map(tuple, S.pair_scores(pairs, ch).filter(S.is_strong()).collect()))
    assert sorted(map(tuple, S.strong_scores(pairs, ch, places=ch.select("doc_id", "seq")).collect())) == want


def test_cells_of_two_levels_are_told_by_titles_before_words_are_compared(spark):
    rows = [(1, 0, "one two three", 1, "a b", 0), (2, 0, "four five six", 2, "a b", 0), (2, 1, "one two three", 2, "c d", 1), (2, 2, "two", 3, "c d", 2), (2, 3, "one two six", 3, "c d", 3), (2, 4, "four", 1, "x", 4)]
    ch, pairs = spark.createDataFrame(rows, CHAPTERS), spark.createDataFrame([(1, 1, 2)], PAIRS)
    t, g = S._sides(pairs, ch, S.BLOCK)
    kept = t.join(g, ["target_doc_id", "block"]).filter(S._may_agree("text", S.CONFIG)).select("g_seq").collect()
    assert {r.g_seq for r in kept} == {1, 2, 3, 4}
