import random

import numpy as np
import pytest

from folioscan.llm import fm_decontam as D
from folioscan.llm.common import table


def test_index_counts_and_locates():
    r = np.random.default_rng(0)
    seq = r.integers(0, 6, 400)
    seq[-1] = 0
    index = D.FMIndex(seq, 5, 4)
    for n in (1, 2, 3, 5):
        words = r.integers(1, 6, (60, n))
        low, high = index.search(words, np.full(60, n))
        for w, a, b in zip(words, low, high):
            want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == w).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_plain_search(spark, block_bytes):
    r = random.Random(5)
    vocab = "a b c d É f1 2 g".split()
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 6, 9])))) for i in range(14)] + [("7", "a b, C"), (None, "g g g g"), ("e", ""), ("n", None), ("p", "?!")]
    docs = []
    for i in range(60):
        t = " ".join(r.choice(vocab + ["zz"]) for _ in range(r.randrange(60)))
        docs.append((i, t + r.choice(["", ".", "\n"]) + (r.choice(items)[1] or "").upper(), "", ""))
    docs += [(100, None, "", ""), (101, "", "", ""), (102, "zz " * 9000 + items[0][1], "", ""), (None, items[1][1], "", ""), (5, docs[5][1], "", "")]
    found = D.search(spark.createDataFrame(docs, "doc_id long, text string, items string, n_hit string"), spark.createDataFrame(items, "item_id string, text string"), window=4, shard_bytes=700, block_bytes=block_bytes)
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in D.digest(found).collect()), key=str)
    want = []
    for i, t, *_ in docs:
        n, hit, names = D.plain(t, [(a or "", b) for a, b in items if b is not None], 4)
        want.append((i, n, hit, len(names), D.items_digest(names), hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=str)


def test_test_table(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = [(str(x.item_id), x.text) for x in bench.collect()]
    got = {x.doc_id: (x.n_words, x.n_hit, sorted(x["items"])) for x in D.verdicts(D.search(docs, bench)).collect()}
    some = sorted(docs.collect(), key=lambda x: len(x.text or ""))[:120]
    for x in some:
        assert got[x.doc_id] == D.plain(x.text, items)
    assert any(v[1] for v in got.values())


def test_cut_and_empty(spark):
    assert D.cut("One, two three. FOUR five", [(1, 3)]) == "One, . FOUR five"
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.search(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0
    assert D.verdicts(D.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench)).first().n_hit == 0


def test_columns_that_clash_but_for_case(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, "x", "y"), (2, None, 9, "x", "y")], "doc_id long, text string, Doc_Id long, TEXT string, Spans string")
    items = spark.createDataFrame([("i", "b")], "item_id string, text string")
    assert sorted((r[0], r[1], r[2]) for r in D.digest(D.search(docs, items)).collect()) == [(1, 3, 1), (2, 0, 0)]
