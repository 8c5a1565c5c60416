import numpy as np

from folioscan.llm import quality_gbdt as Q
from folioscan.llm.common import table


def test_trees_learn_and_walk_like_a_plain_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.BoostedTrees(rounds=30).fit(x, y)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.95
    b = m.binned(x[:40])
    for i in range(40):
        raw = m.base
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if b[i, m.feature[at]] <= m.cut[at] else m.right[at]
            raw += m.value[at]
        assert abs(1 / (1 + np.exp(-raw)) - m.scores(x[i : i + 1])[0]) < 1e-12


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = Q.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = found.filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert sum(r.predicted for r in bad) / len(bad) < 0.15


def test_edges(spark):
    docs = "doc_id long, text string, score string, x array<int>"
    marks = "doc_id long, quality int, text string"
    none = spark.createDataFrame([], marks)
    assert Q.classify(spark.createDataFrame([], docs), none).count() == 0
    rows = [(1, None, "", []), (None, "", "", []), (2, "x" * 200_000, "", []), (2, "x y", "", []), (2, "x y", "", [])]
    got = Q.classify(spark.createDataFrame(rows, docs), none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    marked = spark.createDataFrame([(1, 1, ""), (None, 1, ""), (7, 0, ""), (2, None, ""), (1, 5, "")], marks)
    assert len(Q.classify(spark.createDataFrame(rows, docs), marked).collect()) == 5


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, "good words here " * 9 if i % 2 else "!!" * 40) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40_000)], "doc_id long, quality int")
    got = Q.classify(docs, labels, max_rows=200).collect()
    assert sum((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got) == 400
