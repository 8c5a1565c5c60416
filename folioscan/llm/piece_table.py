"""SentencePiece encoding and decoding of whole texts through a table of distinct chunks.

In a model none of whose pieces has a whitespace marker behind another character, no merge crosses from a word to the marker after
it, so a text's ids are those of its chunks (markers and what follows them) one after the other. Other models are refused.

1. Each task codes batches of texts: every chunk as its number among the batch's chunks.
2. A batch's distinct chunks go, packed by part of their hash, to one place each; there the chunks of all batches become one table,
   and each distinct one is segmented once.
3. Ids go back to the batches, are decoded once for each of a batch's chunks, and ids and texts are joined by position.

A task holds one batch (16 MB of text, or one longer text) or one part, of which there is one for 256 MB of text: the chunks of at
most that much text, were they all distinct. A chunk that is in every batch is one entry a batch. Batches are made twice, from two reads of the same rows; that
both agree is checked by their chunks' crc32, and a difference is an error.

Defined results: a null text is an empty one and has no ids; null and repeated ids are rows like others; the marker character itself
counts as a space, as it does in the library; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import pick, small_batches, total_bytes

MARK = "▁"
BATCH_BYTES = 16 << 20
PART_BYTES = 256 << 20
LEAST_PARTS = 64
DOCS_A_ROW = 256
CHUNK = re.compile(" +[^ ]*")
ROWS = "batch long, kind int, part int, sign long, data binary, doc_ids array<long>, sizes array<int>"
SCHEMA = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("sign", pa.int64()), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
FOUND = "doc_id long, ids array<int>, decoded string"

_READY: dict[str, object] = {}


def processor(path: str):
    """The model, once per Python worker. Pieces that cross markers, or a normaliser that changes spaces, are an error."""
    if path not in _READY:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())) or model.piece_to_id(MARK) == model.unk_id():
            raise ValueError("the model has pieces that cross whitespace markers, or no marker")
        probe = "ﬁ  ① "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK) or model.decode(model.encode(probe)) != probe:
            raise ValueError("the model's normaliser changes texts")
        _READY[path] = model
    return _READY[path]


def segment(model, chunks: list[str]) -> list[list[int]]:
    """Ids of chunks without their first marker."""
    alone = model.piece_to_id(MARK)
    return [ids or [alone] for ids in model.encode(chunks, num_threads=1)]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of all texts without their first marker, the number of each text's, and the order in which the texts come."""
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
    parts = pc.split_pattern(texts, " ")
    ends = parts.offsets.to_numpy()
    flat = parts.flatten()
    empty = np.concatenate(([0], np.cumsum(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))))
    odd = empty[ends[1:] - ends[0]] > empty[ends[:-1] - ends[0]]  # two spaces, or one at an end, or no text
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    if len(rest):
        found = [[c[1:] for c in CHUNK.findall(" " + t)] if t else [] for t in texts.take(pa.array(rest)).to_pylist()]
        parts = parts.take(pa.array(plain))
        ends = parts.offsets.to_numpy()
        flat = pa.concat_arrays([parts.flatten(), pa.array([c for f in found for c in f], pa.large_string())])
        sizes = np.concatenate((np.diff(ends), [len(f) for f in found]))
        return flat, sizes.astype(np.int64), np.concatenate((plain, rest))
    return flat, np.diff(ends).astype(np.int64), plain


def _planes(codes: np.ndarray) -> bytes:
    return zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _codes(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _ends(strings: pa.Array) -> np.ndarray:
    """Where each string of a large_binary array begins, and the last ends."""
    held = strings.buffers()[1]
    return np.frombuffer(held, np.int64)[strings.offset : strings.offset + len(strings) + 1] if held and held.size else np.zeros(1, np.int64)


def _pack(strings: pa.Array) -> bytes:
    """A large_binary array: number of strings, their lengths, their bytes."""
    ends = _ends(strings)
    body = memoryview(strings.buffers()[2] or b"")[int(ends[0]) : int(ends[-1])]
    return zstandard.compress(np.array([len(strings), *np.diff(ends)], "<u4").tobytes() + body.tobytes(), 3)


def _unpacked(data: bytes) -> pa.Array:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(data, "<u4", n, 4).astype(np.int64))))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[4 + 4 * n :])])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def coded(docs: DataFrame, what: str, parts: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """what: 'chunks' for the distinct chunks of each batch by part, 'docs' for its texts as numbers of chunks, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes: list[np.ndarray] = []
        found: list[np.ndarray] = []
        held, made = 0, 0
        known: dict[bytes, int] = defaultdict(lambda: len(known))

        def one() -> Iterator[pa.RecordBatch]:
            number = (TaskContext.get().partitionId() << 24) + made
            chunks = pa.array(list(known), pa.large_binary())
            part = np.fromiter(map(zlib.crc32, known), np.int64, len(known)) % parts
            order = pc.sort_indices(chunks).to_numpy().astype(np.int64)
            order = order[np.argsort(part[order], kind="stable")]  # by part, then by text
            chunks = chunks.take(pa.array(order))
            sign = zlib.crc32(_pack(chunks))
            if what == "chunks":
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
                    if hi > lo:
                        yield _rows([(number, 1, int(part[order[lo]]), sign, _pack(chunks[lo:hi]), None, None)])
                return
            codes, rank = np.concatenate(found), np.empty(len(order), np.uint32)
            rank[np.argsort(-np.bincount(codes, minlength=len(order)), kind="stable")] = np.arange(len(order), dtype=np.uint32)
            yield _rows([(number, 0, -1, sign, _planes(rank[order]), None, None)])
            codes, all_sizes = rank[codes], np.concatenate(sizes)
            ends = np.concatenate(([0], np.cumsum(all_sizes)))
            for a in range(0, len(ids), DOCS_A_ROW):
                b = min(a + DOCS_A_ROW, len(ids))
                yield _rows([(number, 2, a // DOCS_A_ROW, sign, _planes(codes[ends[a] : ends[b]]), ids[a:b], all_sizes[a:b].tolist())])

        for b in batches:
            flat, counts, order = split(b.column("text"))
            doc_ids = b.column("doc_id").to_pylist()
            ids += [doc_ids[i] for i in order.tolist()]
            sizes.append(counts)
            coded_here = flat.cast(pa.large_binary()).dictionary_encode()
            numbers = np.fromiter(map(known.__getitem__, coded_here.dictionary.to_pylist()), np.uint32, len(coded_here.dictionary))
            found.append(numbers[coded_here.indices.to_numpy()])
            held += int(pc.sum(pc.binary_length(flat)).as_py() or 0) + len(flat)
            if held >= batch_bytes:
                yield from one()
                held, made = 0, made + 1
                ids.clear(), sizes.clear(), found.clear(), known.clear()
        if ids:
            yield from one()

    return pick(docs, doc_id="long", text="string").mapInArrow(run, ROWS)


def replies(chunks: DataFrame, model: str) -> DataFrame:
    """The ids of every batch's chunks, part by part; equal chunks of all batches are one entry of a part's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packs = None, []
        for b in batches:
            for at, number, sign, data in zip(*[b.column(c).to_pylist() for c in ("part", "batch", "sign", "data")], strict=True):
                if at != part and packs:
                    yield from _answers(part, packs, processor(model))
                    packs = []
                part = at
                packs.append((number, sign, data))
        if packs:
            yield from _answers(part, packs, processor(model))

    return chunks.select("part", "batch", "sign", "data").repartition("part").sortWithinPartitions("part", "batch").mapInArrow(run, ROWS)


def _answers(part: int, packs: list[tuple[int, int, bytes]], model) -> Iterator[pa.RecordBatch]:
    """One part: the distinct chunks of all its packs are segmented, then every pack gets the ids of its own."""
    strings = [_unpacked(data) for _, _, data in packs]
    bounds = np.cumsum([0, *map(len, strings)])
    known = pa.chunked_array(strings, pa.large_binary()).combine_chunks().dictionary_encode()
    ids: list[bytes] = []
    for k in range(0, len(known.dictionary), 20_000):
        ids += [np.array(x, "<u4").tobytes() for x in segment(model, known.dictionary[k : k + 20_000].cast(pa.large_string()).to_pylist())]
    own, places = pa.array(ids, pa.large_binary()), known.indices
    for (number, sign, _), a, b in zip(packs, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield _rows([(number, 1, part, sign, _pack(own.take(places[a:b])), None, None)])


def joined(docs: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """Ids and decoded text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, batch, sign, table = processor(model), None, None, None
        order, got = None, []
        for b in batches:
            for number, kind, said, data, doc_ids, sizes in zip(*[b.column(c).to_pylist() for c in ("batch", "kind", "sign", "data", "doc_ids", "sizes")], strict=True):
                if kind == 0:
                    batch, sign, order, got, table = number, said, _codes(data), [], None
                if number != batch or said != sign:
                    raise RuntimeError("two reads of the documents differ")
                if kind == 1:
                    got.append(_unpacked(data))
                elif kind == 2:
                    if table is None:
                        if sum(map(len, got)) != len(order):
                            raise RuntimeError("two reads of the documents differ")
                        place = np.empty(len(order), np.int64)
                        place[order] = np.arange(len(order))
                        by_code = pa.chunked_array(got, pa.large_binary()).combine_chunks().take(pa.array(place))
                        starts = _ends(by_code) // 4
                        own = np.diff(starts)
                        ids = np.frombuffer(by_code.buffers()[2] or b"", "<u4").astype(np.int32)
                        texts, cuts = [], starts.tolist()
                        for k in range(0, len(own), 20_000):
                            few = min(k + 20_000, len(own))
                            texts += known.decode([ids[x:y].tolist() for x, y in zip(cuts[k:few], cuts[k + 1 : few + 1], strict=True)])
                        table, got = (own, starts[:-1], ids, texts), []
                    yield from _whole(doc_ids, np.array(sizes, np.int64), _codes(data), *table)

    def _whole(doc_ids, sizes, codes, own, starts, ids, texts) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate(([0], np.cumsum(sizes)))
        n = own[codes]
        before = np.concatenate(([0], np.cumsum(n)))
        all_ids = ids[np.repeat(starts[codes] - before[:-1], n) + np.arange(before[-1])] if len(codes) else np.zeros(0, np.int32)
        words = list(map(texts.__getitem__, codes.tolist()))
        decoded = [" ".join(words[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        lists = pa.LargeListArray.from_arrays(pa.array(before[ends], pa.int64()), pa.array(all_ids, pa.int32())).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.unionByName(answers).repartition("batch").sortWithinPartitions("batch", "kind", "part")
    return rows.mapInArrow(run, FOUND)


def encode(docs: DataFrame, model: str, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, ids and the text decoded from them. ``model``: path of a model file that every executor has."""
    processor(model)
    small_batches(docs.sparkSession, rows=8192)
    parts = max(LEAST_PARTS, -(-total_bytes(docs, "text") // part_bytes))
    return joined(coded(docs, "docs", parts, batch_bytes), replies(coded(docs, "chunks", parts, batch_bytes), model), model)


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
