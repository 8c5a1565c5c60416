import hashlib
import random
import re

from pyspark.sql import functions as F

from folioscan.llm import pii_votes as V
from folioscan.llm.common import table

SCHEMA = "doc_id long, text string, base string, cands string, spans string"


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for k, kind in enumerate(V.KINDS):
        for m in re.finditer(V.PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check(found, docs):
    got = {}
    for r in V.digest(found).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in docs:
        spans = plain(t)
        said = ",".join(f"{V.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = got[i].pop()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)], t
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, said, r.spans)
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_on_noise(spark):
    r = random.Random(4)
    bits = ["a@b.c", "x", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (310) 555-4510", "+", "é", "𝒳", " ", "-", "\n", "0001.2.3.004", "1234567890123456789012", "_d@e.f.g", "5", "a.b%c", "(", "++12 34567 89"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randrange(30))), "", "", "") for i in range(600)]
    docs += [(1000, None, "", "", ""), (1001, "", "", "", ""), (1002, "a" * 60_000, "", "", ""), (1003, "1." * 40_000, "", "", ""), (1004, "a@b" + ".c" * 20_000, "", "", ""), (1005, "1 " * 30_000, "", "", ""), (1006, "1" * 50_000 + "@", "", "", ""), (7, docs[7][1], "", "", ""), (None, "m a@b.cd", "", "", "")]
    check(V.find(spark.createDataFrame(docs, SCHEMA)), docs)


def test_base_spans_on_the_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    check(V.find(docs), [tuple(x) for x in docs.collect()])


def test_method_adds_spans_and_masks(spark):
    r = random.Random(1)
    n = lambda k: "".join(r.choice("23456789") for _ in range(k))
    docs = [(i, f"tel: +1 ({n(3)}) {n(3)}-{n(4)} and a{i}@b{i}.com or call ({n(3)}) {n(3)}-{n(4)} now", "", "", "") for i in range(80)]
    docs.append((99, "ann [at] site [dot] com; x, y@z.net!", "", "", ""))
    found = V.find(spark.createDataFrame(docs, SCHEMA))
    by = {x.doc_id: x.spans for x in V.digest(found).collect()}
    assert all(by[i].count("phone:") == 2 for i in range(80))
    rows = spark.createDataFrame(docs, SCHEMA).select("doc_id", "text").join(found, "doc_id").select("doc_id", V.masked(F.col("text"), F.col("spans")).alias("m"))
    out = {x.doc_id: x.m for x in rows.collect()}
    assert out[0] == "tel: [PHONE] and [EMAIL] or call [PHONE] now"
    assert out[99].endswith("x, [EMAIL]!")


def test_estimation_finds_the_reliable_labeler():
    r = random.Random(0)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.4
        v = tuple((1 if (y if r.random() < p else not y) else -1) for p in (0.95, 0.9, 0.85, 0.55, 0.5))
        counts[v] = counts.get(v, 0) + 1
    q = V.estimate([(0, *v, n) for v, n in counts.items()])
    assert q[0, 1, 1, 1, -1, -1] > 0.95 and q[0, -1, -1, -1, 1, 1] < 0.05


def test_the_classifier_beats_the_votes_it_learns_from():
    """Noisy labelers, and features that tell more than any of them: spans that look alike share what their votes say."""
    r = random.Random(7)
    counts, truth = {}, {}
    for _ in range(6000):
        y = r.random() < 0.5
        v = tuple((1 if (y if r.random() < 0.68 else not y) else -1) for _ in V.LABELERS)
        f = tuple(min(n - 1, (2 if y else 0) + r.randrange(2)) if i < 3 else r.randrange(n) for i, n in enumerate(V.FEATURES.values()))
        key = (0, *v, *f)
        counts[key] = counts.get(key, 0) + 1
        truth.setdefault(key, [0, 0])[y] += 1
    votes = {}
    for k, n in counts.items():
        votes[k[: 1 + len(v)]] = votes.get(k[: 1 + len(v)], 0) + n
    model, posterior = V.SpanClassifier([(*k, n) for k, n in counts.items()]), V.estimate([(*k, n) for k, n in votes.items()])
    right = lambda says: sum(t[says(k) >= 0.5] for k, t in truth.items()) / 6000
    by_votes, by_model = right(lambda k: posterior[k[: 1 + len(v)]]), right(lambda k: model.probability(0, k[2:]))
    assert by_model > by_votes + 0.03, (by_model, by_votes)


def test_no_python_in_the_plan_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert V.find(empty).count() == 0
    plan = V.digest(V.decide(V.candidates(empty.select("doc_id", "text")), V.SpanClassifier([])))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_many_matches_in_one_text(spark):
    import time

    parts = [f"10.0.{i // 250}.{i % 250}" if i % 2 else f"u{i}@h{i}.org" if i % 4 else "999.1.2.3" for i in range(20_000)]
    docs = [(0, " ".join(parts), "", "", ""), (1, ",".join(f"1.2.3.4@b.c{i}" for i in range(500)), "", "", "")]
    df = spark.createDataFrame(docs, SCHEMA)
    began = time.time()
    found = V.find(df)
    check(found, docs)
    rows = df.select("doc_id", "text").join(found, "doc_id").select("doc_id", "text", "spans", V.masked(F.col("text"), F.col("spans")).alias("m")).collect()
    assert time.time() - began < 60
    for r in rows:
        out, at = [], 0
        for a, k, b in r.spans:
            if a >= at:
                out += [r.text[at:a], f"[{V.KINDS[k].upper()}]"]
            at = max(at, b)
        assert r.m == "".join(out) + r.text[at:]
