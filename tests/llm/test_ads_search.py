import numpy as np

from folioscan.llm import ads_search as A
from folioscan.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, x string, list int"


def plain(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.einsum("ij,ij->i", np.broadcast_to(x[i], x.shape), x)
        s[ids == ids[i]] = -np.inf
        at = A.best(s, ids, min(k, len(ids) - 1))
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in at]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores_on_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = plain([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = found(A.search(vectors, A.multiples()))
    assert got.keys() == want.keys()
    recall = np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 20 for q in want])
    assert recall >= 0.9, recall
    for q in want:
        exact = dict(want[q])
        assert all(abs(s - exact[a]) < 1e-12 for a, s in got[q] if a in exact)


def test_recall_with_a_sample_of_a_tenth(spark):
    r = np.random.default_rng(8)
    x = np.repeat(r.normal(size=(30, 32)), 100, axis=0) + r.normal(size=(3000, 32))
    rows = [(i, v, "", 0) for i, v in enumerate(x.tolist())]
    df, want = spark.createDataFrame(rows, SCHEMA), plain(rows, 20)
    share = lambda got: np.mean([len({a for a, _ in want[q]} & {a for a, _ in got.get(q, [])}) / 20 for q in want])
    assert share(found(A.search(df, A.multiples(), sample=300))) >= 0.9
    assert share(found(A.search(df, A.multiples(), sample=300, sigmas=-99))) < 0.5  # what the scan abandons comes from nowhere else


def test_enough_lists_are_probed_without_clusters():
    r = np.random.default_rng(3)
    x = r.normal(size=(12_000, 32))
    lists = A.Lists(x[:5000], 40)
    probes, own = lists.needed(x[:5000], 20, 0.97), lists.place(x)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([np.isin(own[t], p).mean() for t, p in zip(top, lists.probe(x[:200], probes))]) > 0.93
    clustered = np.repeat(r.normal(size=(40, 32)) * 9, 100, axis=0) + r.normal(size=(4000, 32))
    assert A.Lists(clustered, 40).needed(clustered, 20, 0.97) < 10


def test_edges_ties_and_hot_vector(spark):
    r = np.random.default_rng(1)
    hot = r.normal(size=8).astype(np.float32)
    rows = [(i, hot if i % 3 == 0 else r.normal(size=8).astype(np.float32)) for i in range(300)]
    good = [(i, v.tolist(), "", 0) for i, v in rows]
    bad = [(900, None, "", 0), (920, [0.0] * 8, "", 0), (940, [None] + [1.0] * 7, "", 0), (960, [float("nan")] * 8, "", 0), (980, [float("inf")] * 8, "", 0), (None, hot.tolist(), "", 0), (1000, [1.0] * 3, "", 0)]
    df = spark.createDataFrame(good + bad + good[:5], SCHEMA)
    got = found(A.search(df, A.multiples(), probes=1000, block=40, sigmas=1e9))
    want = plain(rows, 20)
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}
    assert A.search(spark.createDataFrame([], SCHEMA), A.multiples()).count() == 0
    few = found(A.search(spark.createDataFrame(good[:4], SCHEMA), A.multiples()))
    assert [a for a, _ in few[0]] == [3, 2, 1] or len(few[0]) == 3


def test_groups_of_copies_stay_in_the_scan():
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(60, 64)), 200, axis=0) + 0.35 * r.normal(size=(12_000, 64))
    x = r.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    ids, rotation = np.arange(len(x)), A.Lists(x[:500], 1).rotation
    q = np.arange(0, len(x), 60)
    first = x[q] @ x[:3000].T
    first[q[:, None] == ids[:3000]] = -np.inf
    i, j, _ = A.scanned(x[q], x, ids, ids[q], rotation, bars=np.sort(first, axis=1)[:, -20])
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    recall = np.mean([np.isin(t, j[i == n]).mean() for n, t in enumerate(top)])
    assert recall > 0.98, recall


def test_equal_scores_beyond_the_sample_go_to_smaller_ids(spark):
    r = np.random.default_rng(6)
    hot = (3 * r.normal(size=64)).astype(np.float32).tolist()
    rows = [(i, hot if i % 4 else r.normal(size=64).astype(np.float32).tolist(), "", 0) for i in range(1200)]
    got = found(A.search(spark.createDataFrame(rows, SCHEMA), A.F.col("vec_id").isin(1, 30, 1199), sample=200, block=100))
    for n in (1, 30, 1199):
        assert [a for a, _ in got[n]] == [i for i in range(40) if i % 4 and i != n][:20]
