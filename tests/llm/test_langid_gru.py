import numpy as np

from folioscan.llm import langid_gru as L
from folioscan.llm.common import table

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def test_gradients_against_differences():
    net = L.ByteGRU(["a", "b", "c"], hidden=3)
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (7, 4)), np.array([0, 2, 1, 0])
    _, grad = net.step(x, y)
    for name, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = net.step(x, y)[0]
        net.p[name][at] = old - 1e-5
        down = net.step(x, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_use_matches_training_pass():
    """Each window's states are those of reading it with its context; with a context as long as the text, those of the whole text."""
    net = L.ByteGRU(["a", "b"], hidden=4)
    raws = [b"hello world, this is", b"", b"x", bytes(range(50, 90)), b"12345678"]
    for context in (0, 3, 64):
        got = net.documents(raws, window=8, context=context)
        for raw, row in zip(raws, got):
            want = np.zeros(2)
            for k in range(0, len(raw), 8):
                end = min(k + 8, len(raw))
                a, b = max(0, k - context), min(len(raw), end + context)
                x = np.frombuffer(raw[a:b], np.uint8)[:, None].astype(int)
                f, g = net._read("f", x[: end - a])[0][k - a :], net._read("b", x[k - a :][::-1])[0][::-1][: end - k]
                e = np.exp(np.concatenate((f, g), 2) @ net.p["w"] + net.p["b"])
                want += (e / e.sum(2, keepdims=True)).sum((0, 1))
            assert np.allclose(row, want / max(1, len(raw)), atol=1e-4)


def test_states_from_further_away_have_faded(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    net = L.fit(docs)
    raws = [r.text.encode()[:4000] for r in docs.filter("length(text) > 3000").limit(8).collect()]
    assert np.abs(net.documents(raws) - net.documents(raws, window=4000)).max() < 0.01


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_edges(spark):
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, "en", "", ""), (None, "", "en", "", ""), (3, "12 3!", "de", "", ""), (4, "abc", None, "", ""), (4, "abc", None, "", "")]
    assert {(r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}
    got = L.identify(spark.createDataFrame([*rows, (6, "word " * 90_000, "xx", "", ""), (9, "word", "xx", "", "")], SCHEMA)).collect()
    assert sorted(r.lang_pred for r in got) == ["und"] * 3 + ["xx"] * 4


def test_every_language_is_learnt(spark):
    rows = [(i, f"text of language {i % 70}", f"l{i % 70:02}", "", "") for i in range(420)] + [(i, "rare words", "rare", "", "") for i in range(1000, 1006)]
    assert L.fit(spark.createDataFrame(rows, SCHEMA)).langs == [*(f"l{i:02}" for i in range(70)), "rare"]


def test_a_language_of_one_repeated_id_and_many_languages(spark):
    rows = [(7, f"ein Satz {i} hier", "one", "", "") for i in range(3000)] + [(i, "la phrase", "two", "", "") for i in range(100, 200)] + [(8, "copy", "copies", "", "")] * 500
    net = L.fit(spark.createDataFrame(rows, SCHEMA), per_lang=20)
    assert net.langs == ["copies", "one", "two"]
    many = spark.createDataFrame([(i, f"text {i}", f"l{i % 3000:04}", "", "") for i in range(9000)], SCHEMA)
    counted = []
    L.ByteGRU.train, kept = lambda self, texts, labels: counted.append(np.bincount(labels)) or self, L.ByteGRU.train
    try:
        assert len(L.fit(many, most=6000).langs) > 2800  # the others have held-out rows only
    finally:
        L.ByteGRU.train = kept
    assert counted[0].max() <= 2 and counted[0].min() == 1


def test_numerals_are_no_letters(spark):
    assert [L.has_letter(t) for t in (None, "", "½ 10²", "①Ⅷ", "_-", "é", "1a", "語")] == [False] * 5 + [True] * 3


def test_space_of_states_is_used_again():
    """Results do not depend on what was read before, and reading on takes no new space for the states."""
    raws = [bytes(range(32, 122)) * k for k in (1, 9, 2, 0, 30)]
    net, other = L.ByteGRU(["a", "b", "c"]), L.ByteGRU(["a", "b", "c"])
    want = other.documents(raws)
    net.documents(raws[::-1])
    room = {d: id(a) for d, a in net.room.items()}
    assert np.array_equal(net.documents(raws), want)
    assert len(room) == 2 and {d: id(a) for d, a in net.room.items()} == room


def test_large_weights_and_many_languages():
    net = L.ByteGRU([f"l{k}" for k in range(40)])
    net.p["w"] *= 1000
    got = net.documents([b"some text of a few words"])
    assert np.isfinite(got).all() and abs(got.sum() - 1) < 1e-4
