import random
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from folioscan.llm import piece_table as P
from folioscan.llm.common import table
from folioscan.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, Batch long"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain(model, rows):
    out = []
    for i, t in rows:
        ids = model.encode(t or "", num_threads=1)
        out.append((i, ids, model.decode(ids)))
    return sorted(out, key=repr)


def odd_texts(seed, n):
    r = random.Random(seed)
    bits = ["the", "Über", " ", "  ", "▁", "a▁b", "\t", "\n", "　", "é", "日本語の", "😀", "\x00", "<s>", "<0x20>", "x" * 50, ".", "1234", "ﬁ", "​", "     "]
    return ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(n)]


def test_every_text_as_the_library(spark, model):
    rows = [(i % 97 if i % 11 else None, t) for i, t in enumerate([None, "", " ", "▁", "a ", " a", "  a  b ", *odd_texts(3, 700)])]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3)
    for batch in (P.BATCH_BYTES, 2000):
        got = sorted(((r[0], list(r[1]), r[2]) for r in P.encode(df, MODEL, batch_bytes=batch, part_bytes=1 << 30).collect()), key=repr)
        assert got == plain(model, rows)


def test_long_text_copies_and_empty_table(spark, model):
    text = " ".join(odd_texts(5, 30_000)) + "y" * 100_000
    rows = [(1, text), (2, "same words here")] + [(3, "same words here")] * 500
    got = P.encode(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), MODEL).collect()
    assert sorted(((r[0], list(r[1]), r[2]) for r in got), key=repr) == plain(model, rows)
    assert P.encode(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_split_gives_whole_texts_back():
    texts = [None, "", "a b", " a", "a  b ", "▁", "x"]
    flat, sizes, order = P.split(pa.array(texts))
    chunks, at = flat.to_pylist(), 0
    for i, n in zip(order.tolist(), sizes.tolist(), strict=True):
        assert "".join(" " + c for c in chunks[at : at + n])[1:] == (texts[i] or "").replace("▁", " ")
        at += n
    assert at == len(chunks)


def test_chunks_of_many_batches_get_an_answer_each(spark):
    words = ["alpha", "beta", "gamma"] * 400
    df = spark.createDataFrame([(i, " ".join(words), "", 0) for i in range(40)], SCHEMA).repartition(12)
    chunks = P.coded(df, "chunks", 5, 4000)
    assert chunks.select("batch").distinct().count() > 8  # many batches hold the same three chunks
    assert P.replies(chunks, MODEL).select("batch", "part").distinct().count() == chunks.count()


def test_query(spark, sf, model):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = [(i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest()) for i, ids, t in plain(model, rows)]
    got = QUERIES["op11_piece_table"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
