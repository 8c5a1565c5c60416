import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscan.llm import cost_packing as C
from folioscan.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_assignment_is_whole_and_tight(lengths):
    rows = C.assign(lengths, 64)
    by_doc, by_seq = {}, {}
    for d, a, n, s, o in rows:
        by_doc.setdefault(d, []).append((a, n))
        by_seq.setdefault(s, []).append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(by_doc[d]):
            assert a == at and k > 0
            at += k
        assert at == n
    fills = []
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        fills.append(at)
    assert all(f <= 64 for f in fills) and sum(f < 64 for f in fills) <= 1


def test_costs_are_even():
    rows = C.assign([40] * 8 + [8] * 24, 64)
    cost = {}
    for _, _, n, s, _ in rows:
        cost[s] = cost.get(s, 0) + n + n * n / 64
    assert max(cost.values()) - min(cost.values()) < 40


ODD = ["a", "Z", "é", "Σ", "İ", "ß", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u0301", "\u0307", "'S", "'", ".", "!?", "7", "²", "漢", "\U0001f600", "\x00", "ﬁ"]


def _same(texts):
    whole, words = Tokenizer.from_file(PATH), C.WordTokens(PATH, most=200)
    ids, ends = words.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join), min_size=1, max_size=30))
def test_any_text_gives_the_tokenizers_ids(texts):
    _same(texts)


def test_chunks_give_the_tokenizers_ids():
    _same([])
    _same(["Hello, WORLD's  é x", "", None, "a\x1cb c", "<|endoftext|> x<|startoftext|>y", "é ́a 12,5%", "x" * 5000, "ΑΣ Σ.", "<|ENDOFTEXT|> İx. it's. don'T! a.b, é̀. ab... x_y. ²³. a1.", "Σ\xa0İ!", " ".join(map(str, range(999)))])


def test_pieces_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    whole = Tokenizer.from_file(PATH)
    got = {}
    rows = C.pack(docs, PATH).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sum(n < 4096 for n in fill.values()) <= docs.rdd.getNumPartitions() and max(fill.values()) <= 4096
    for d in docs.collect():
        ids = [*whole.encode(d.text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(got[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, start int, length int"
    assert C.pack(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(1, None, 0, 0), (None, "", 0, 0), (2, "a b", 0, 0), (2, "a b", 0, 0)]
    got = C.pack(spark.createDataFrame(rows, schema).coalesce(1), PATH).collect()
    assert sorted(((r.doc_id or 0), r.length) for r in got) == [(0, 1), (1, 1), (2, 3), (2, 3)]
    assert sorted((r.offset, r.length) for r in got)[0][0] == 0 and {r.padded_to for r in got} == {8}
