import random
from collections import Counter

from folioscan.operators import renumber as R

CHAPTERS = "doc_id long, seq int, title string, level int, content string, position int"


def plain(t, g):
    """All patterns of one level from lists of (seq, nums), straight from the definitions."""
    out, dot = {}, lambda n: ".".join(map(str, n))
    pairs = [(b[1][-1] - a[1][-1], dot(a[1]), dot(b[1])) for a in t for b in g if len(a[1]) == len(b[1])]
    if len(t) >= 2 and len(g) >= 2 and pairs:
        best, n = Counter(x[0] for x in pairs).most_common(1)[0]  # the first seen of equal ones
        if best and n / len(pairs) >= 0.6:
            out["offset"] = (best, n / len(pairs), [x[1:] for x in pairs if x[0] == best][:3])
    a, b = [x[1][-1] for x in t], [x[1][-1] for x in g]
    if len(a) >= 3 and sorted(a) == sorted(b) and a != b:
        moved = [(str(x), str(y)) for x, y in zip(a, b, strict=True) if x != y]
        if 1 - len(moved) / len(a) >= 0.3:
            out["reorder"] = (0, 1 - len(moved) / len(a), moved[:3])
    for kind, one, two in (("insertion", g, t), ("deletion", t, g)):
        own, other = {tuple(x[1]) for x in one}, {tuple(x[1]) for x in two}
        if len(one) > len(two) >= 2 and own - other and len(own - other) / len(own) >= 0.1:
            new = [dot(x) for x in sorted(own - other)[:3]]
            out[kind] = (0, len(own - other) / len(own), [("", x) if kind == "insertion" else (x, "") for x in new])
    return out


def test_patterns_equal_the_definitions():
    r = random.Random(6)
    seen = Counter()
    for _ in range(6000):
        t = [(i, [r.randrange(4) for _ in range(r.choice([0, 0, 1]))] + [r.randrange(1, r.choice([4, 9, 70]))]) for i in range(r.randrange(8))]
        g = [(i, [*n[:-1], n[-1] + r.choice([1, 1, 1, 0])]) for i, n in t] if r.random() < 0.5 else [(i, n) for i, (_, n) in enumerate(r.sample(t, len(t)))]
        g = g[: r.randrange(len(g) + 1)] if r.random() < 0.4 else g + [(90 + k, [r.randrange(40)]) for k in range(r.randrange(3))]
        got = {k: (o, c, e) for k, o, c, e, _ in R.patterns_of(1, t, g, R.LEAST)}
        want = plain(t, g)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 and got[k][2] == want[k][2] for k in want), (t, g, got, want)
        seen.update(list(want))
    assert min(seen[k] for k in ("offset", "reorder", "insertion", "deletion")) > 50


def test_many_different_numbers():
    r = random.Random(1)
    t, g = [r.randrange(10**12) for _ in range(300)], [r.randrange(10**12) for _ in range(300)]
    assert R.differences(t, g) == Counter(b - a for a in t for b in g)
    assert R.differences([1 << 62] * 70 + list(range(100)), list(range(200)))[0] == 100


def test_one_template_serves_all_pairs(spark):
    docs = {0: [f"{i} a" for i in range(1, 8)]} | {d: [f"{i + 1} a" for i in range(1, 8)] for d in range(1, 60)}
    ch = spark.createDataFrame([(d, i, t, 1, "", i) for d, ts in docs.items() for i, t in enumerate(ts)], CHAPTERS)
    pairs = spark.createDataFrame([(d, 0, d) for d in range(1, 60)], "pair_id long, template_doc_id long, target_doc_id long")
    rows = R.detect_patterns(pairs, ch)
    got = {x.pair_id: (x.pattern_type, x.offset_value, x.confidence) for x in rows.collect()}
    share = Counter(b - a for a in range(1, 8) for b in range(2, 9))[1] / 49
    assert got == ({d: ("offset", 1, share) for d in range(1, 60)} if share >= 0.6 else {})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") < 40
