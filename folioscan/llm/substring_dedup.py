"""Exact removal of repeated byte strings, decided by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id. Documents are
dealt by hash to batches of about ``batch_bytes``, and batches learn about each other in three rounds of small messages:

1. Every string of ``length`` bytes holds an anchor: the place of the smallest hash among its strings of ``SEED`` bytes. Equal
   strings have equal anchors at equal places. They are found once, before texts are dealt out, and travel as a bit for each
   byte. Batches report anchor hashes and hear which ones several documents have.
2. For those they report a hash of the anchor's surroundings (all bytes that a string with this anchor can hold) with the
   smallest doc_id, and hashes of the anchor with the half of the remaining bytes to its left and to its right: a string
   always holds one of the two. Where surroundings also occur in a smaller document, all strings with the anchor go.
3. Left are anchors whose surroundings are new but whose left or right half occurs with other surroundings too. The
   smallest document's text around them goes through a suffix array of its batch, built by grouping suffixes under Lyndon
   prefixes (``suffix_groups``), ranks of eight bytes being the symbols: neighbours in it that share ``length`` bytes are one
   string. The batches report these strings with the smallest doc_id of each, hear where another batch has a smaller one,
   then mark and cut.

Nothing is dropped or capped, and no key's messages grow with the number of documents in a batch: a batch sends two entries
at most for a key. Batches and buckets of messages grow in number with the input, documents counting 64 bytes besides their
text. Keys have 96 bits in rounds 2 and 3, in messages and replies; equal keys are taken for equal strings.

Defined results: a null text is empty; a null doc_id counts as larger than all others, so its strings remove nothing; rows
that repeat a doc_id remove nothing from each other; texts below ``length`` bytes stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import as_bytes, pick, small_batches, total_bytes
from folioscan.llm.suffix_groups import suffix_array, widened

LENGTH = 50
SEED = 24
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20
_PART = 1 << 15
#: Bytes that one suffix array covers, and bytes of texts that are dealt out together.
SORTED_BYTES = 1 << 14
DEALT_BYTES = 32 << 20
DEALT = "batch long, ids array<long>, sizes array<int>, texts binary, anchors binary"
DOCUMENT_BYTES = 64
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
MESSAGES = "bucket int, batch long, kind int, high binary, low binary, value binary"
REPLIES = "batch long, bucket int, kind int, high binary, low binary"
#: Kinds of messages. Of SHORT ones the reply says that the key has several values; their keys have 31 bits within a bucket, for
#: a chance equality only makes more to look at. The others' replies name the keys for which another batch has a smaller value.
ANCHOR, AROUND, HALF, STRING = range(4)
SHORT = (ANCHOR, HALF)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as one number; data ends with 8 spare bytes."""
    n = len(data) - 8
    out = np.empty(n, np.uint64)
    for k in range(8):
        m = len(range(k, n, 8))
        out[k::8] = data[k : k + 8 * m].view("<u8")
    return out


def _words_at(data: np.ndarray) -> np.ndarray:
    """The same without a copy, for picking single ones."""
    return np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))


def joined(first: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs that ranges of documents cover, in order; ranges that touch are one run if one document owns both."""
    order = np.argsort(first, kind="stable")
    first, owner, far = first[order], owner[order], np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] > far[:-1]) | (owner[1:] != owner[:-1])
    return first[new], far[np.concatenate((np.flatnonzero(new)[1:], [len(order)])) - 1] if len(order) else far, owner[new]


def _sliding(x: np.ndarray, width: int, f, edge: int) -> np.ndarray:
    """f (minimum or maximum) over x[i : i + width]; past the end counts as edge."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = f(out[:-step], out[step:])
        out[-step:] = f(out[-step:], x.dtype.type(edge))
        have += step
    return out


def range_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits (64 and 32) for the bytes from each start; ranges shorter than 8 bytes count their bytes in one number."""
    size = np.broadcast_to(size, start.shape)
    high = _mix((size.astype(np.uint64) + np.uint64(1000 * salt)) * _A)
    low = _mix(high * _C)
    last = np.maximum(start, start + size - 8)
    short = np.uint64(8) * np.minimum(size, 8).astype(np.uint64)
    mask = np.where(size >= 8, ~np.uint64(0), (np.uint64(1) << (short & np.uint64(63))) - np.uint64(1))
    for k in range(0, int(size.max(initial=0)), 8):
        w = words[np.minimum(start + k, last)] & mask
        use = k < size
        high = np.where(use, _mix((high ^ w) * _C + _A), high)
        low = np.where(use, _mix((low + w) * _A ^ _B), low)
    return high, (low >> np.uint64(32)).astype(np.uint32)


def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the first one counts most) and where a new value of the first two begins in it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys[:2]:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def extremes(high: np.ndarray, low: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys with their smallest and, where it differs, their largest value."""
    order, runs = firsts(high, low, value)
    if not len(runs):
        return high, low, value
    last = np.concatenate((runs[1:], [len(order)])) - 1
    last = last[value[order[last]] != value[order[runs]]]
    at = order[np.concatenate((runs, last))]
    return high[at], low[at], value[at]


def smallest(high: np.ndarray, low: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, runs = firsts(high, low, value)
    at = order[runs]
    return high[at], low[at], value[at]


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some, a sorted array."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def least_of(high: np.ndarray, low: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each entry the smallest value of its key."""
    order, runs = firsts(high, low, value)
    out = np.empty(len(value), np.int64)
    if len(runs):
        out[order] = np.repeat(value[order[runs]], np.diff(np.concatenate((runs, [len(order)]))))
    return out


def among_full(high: np.ndarray, low: np.ndarray, some: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which keys of 96 bits are among some, sorted by their high parts."""
    found, at = np.zeros(len(high), bool), np.searchsorted(some[0], high)
    live = np.flatnonzero(at < len(some[0]))
    while len(live):
        live = live[some[0][at[live]] == high[live]]
        found[live] = some[1][at[live]] == low[live]
        at[live] += 1
        live = live[~found[live] & (at[live] < len(some[0]))]
    return found


def _mixed_seeds(words: np.ndarray, at, seed: int) -> np.ndarray:
    """Nonzero hashes of the strings of seed bytes; at(k) gives the words k bytes further on."""
    if seed < 8:
        return _mix(_mix(at(0) & np.uint64((1 << 8 * seed) - 1)) * _A) | np.uint64(1)
    h = at(0) * _A
    for k in [*range(8, seed - 7, 8), *([seed - 8] if seed % 8 else [])]:
        h = (h ^ (h >> np.uint64(31)) ^ at(k)) * _C
    return _mix(_mix(h) * _A) | np.uint64(1)


def anchors_of(raws: list[bytes], length: int) -> np.ndarray:
    """For each byte of the documents, one after the other, whether an anchor starts there."""
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(raws) else 0
    words = _words(np.frombuffer(b"".join(raws) + bytes(length + 64), np.uint8))
    cut_off = np.zeros(n, bool)  # where a string would leave its document
    short_of = ends[:, None] - np.arange(1, length)
    cut_off[short_of[short_of >= (ends - sizes)[:, None]]] = True
    seed, reach, found = min(SEED, length), length - min(SEED, length), np.zeros(n, bool)
    for lo in range(0, n, _PART):  # small parts stay in the processor's caches
        hi, a, b = min(n, lo + _PART), max(0, lo - reach), min(n, lo + _PART + reach)
        h = (_mixed_seeds(words, lambda k, a=a, b=b: words[a + k : b + k], seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = _sliding(h, reach + 1, np.minimum, np.iinfo(np.uint32).max)[: hi - a]
        low[cut_off[a:hi]] = 0
        high = _sliding(low[::-1].copy(), reach + 1, np.maximum, 0)[::-1]
        found[lo:hi] = h[lo - a : hi - a] == high[lo - a :]
    return found


class Batch:
    """Some documents as one byte sequence, with their anchors."""

    def __init__(self, ids: list, raws: list[bytes], anchors: list[np.ndarray], length: int):
        keys = np.array([LAST if i is None else i for i in ids], np.int64)
        order = np.argsort(keys, kind="stable")
        self.ids, self.raws, self.keys, self.length = [ids[k] for k in order], [raws[k] for k in order], keys[order], length
        sizes = np.array([len(r) for r in self.raws], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.data = np.frombuffer(b"".join(self.raws) + bytes(length + 64), np.uint8)
        self.words = _words_at(self.data)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.seed, self.reach = min(SEED, length), length - min(SEED, length)
        self.at = np.flatnonzero(np.concatenate([np.zeros(0, bool), *(anchors[k] for k in order)]))
        self.hash = _mixed_seeds(self.words, lambda k: self.words[self.at + k], self.seed)
        self.doc = self.owner[self.at]
        self.left = np.maximum(self.at - self.reach, self.starts[self.doc])
        self.right = np.minimum(self.at + length, self.starts[self.doc + 1])

    def choose(self, which: np.ndarray) -> None:
        """Goes on with some anchors only."""
        self.at, self.hash, self.doc, self.left, self.right = self.at[which], self.hash[which], self.doc[which], self.left[which], self.right[which]

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the surroundings, with where the anchor lies in them."""
        high, low = range_hashes(self.words, self.left, self.right - self.left, 1)
        return _mix(high + (self.at - self.left).astype(np.uint64) * _A), low

    def halves(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, keys) with half of the remaining bytes to the left, and to the right, where there are as many."""
        half = (self.reach + 1) // 2
        out = []
        for salt, start in ((2, self.at - half), (3, self.at)):
            some = np.flatnonzero((start >= self.left) & (start + half + self.seed <= self.right))
            out.append((some, *range_hashes(self.words, start[some], np.int64(half + self.seed), salt)))
        return out

    def strings(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Start places of all strings that lie in the surroundings of an anchor of left and hold the half to its left, or of one
        of right and hold the half to its right."""
        half = (self.reach + 1) // 2
        last = np.minimum(self.at, self.right - self.length)
        a = np.concatenate((self.left[left], np.maximum(self.left, self.at - self.reach + half)[right]))
        b = np.concatenate((np.minimum(last, self.at - half)[left], last[right])) + 1
        some = a < b
        a, b, _ = joined(a[some], b[some], np.concatenate((self.doc[left], self.doc[right]))[some])
        sizes = b - a
        return np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))

    def grouped(self, places: np.ndarray, most: int = SORTED_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and smallest document of the different strings at places, found in suffix arrays of the parts they cover.

        Parts that occur several times enter once, with the smallest document that has them. A suffix array covers about
        ``most`` bytes; strings that several of them hold meet by their keys, as those of different batches do."""
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not len(places):
            return none
        cut = np.concatenate(([True], (np.diff(places) > 1) | (np.diff(self.owner[places]) > 0)))
        begin = places[cut]
        end = np.concatenate((places[np.flatnonzero(cut)[1:] - 1], places[-1:])) + self.length
        parts: dict[bytes, int] = {}
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            parts.setdefault(self.data[a:b].tobytes(), a)  # documents are in order: the first has the smallest key
        found, some, size = [], [], 0
        for part, a in parts.items():
            some.append((part, a))
            size += len(part)
            if size >= most:
                found.append(self._sorted(some))
                some, size = [], 0
        if some:
            found.append(self._sorted(some))
        return smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _sorted(self, parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, source, inside = [], [], []
        for part, a in parts:
            n = len(part)
            text += [np.frombuffer(part, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
            source.append(np.arange(a, a + n + 1))
            inside.append(np.arange(n + 1) <= n - self.length)
        order = np.array(suffix_array(widened(np.concatenate([*text, np.zeros(1, np.int64)]))))[1:]
        order = order[np.concatenate(inside)[order]]
        at = np.concatenate(source)[order]
        same = np.ones(len(at) - 1, bool)
        for k in [*range(0, self.length - 7, 8), max(0, self.length - 8)]:
            same &= self.words[at[1:] + k] == self.words[at[:-1] + k]
        if self.length < 8:
            mask = np.uint64((1 << 8 * self.length) - 1)
            same = (self.words[at[1:]] & mask) == (self.words[at[:-1]] & mask)
        runs = np.flatnonzero(np.concatenate(([True], ~same)))
        keys = np.minimum.reduceat(self.keys[self.owner[at]], runs)
        return (*range_hashes(self.words, at[runs], np.int64(self.length), 4), keys)

    def covered(self, hits: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """Result rows; hits: first and last byte (exclusive) of what goes."""
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*hits, strict=True))
        some = a < b
        a, b, owner = joined(a[some], b[some], self.owner[a[some]])
        starts, edges = self.starts.tolist(), np.searchsorted(owner, np.arange(len(self.raws) + 1)).tolist()
        a, b = a.tolist(), b.tolist()
        out = []
        for d, raw in enumerate(self.raws):
            at, lo, hi = starts[d], edges[d], edges[d + 1]
            spans = [(a[k] - at, b[k] - at) for k in range(lo, hi)]
            kept = raw if lo == hi else b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
            out.append((self.ids[d], len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        return out


def short(high: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 31 bits of a key; the last bit is free."""
    return ((high % np.uint64(buckets)) << np.uint64(32)) | ((high >> np.uint64(32)) & np.uint64(0xFFFFFFFE))


def _coded(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers, or the steps between them, with all first bytes first, compressed."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _decoded(raw: bytes, dtype, rising: bool = False) -> np.ndarray:
    raw, size = zstandard.ZstdDecompressor().decompress(raw), np.dtype(dtype).itemsize
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if rising else x


def _packed(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _sent(batch: int, parts: list[tuple[int, tuple]], buckets: int) -> pa.Table:
    """Messages by bucket of their keys. Anchors come as short keys whose last bit says that the batch has several documents
    with them, halves as short keys with the surroundings' name."""
    rows = []
    for kind, (high, low, value) in parts:
        bucket = (high >> np.uint64(32) if kind in SHORT else high % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[k] : edges[k + 1]]
            if kind in SHORT:
                said = _coded(high[at].astype(np.uint32), True), b"", b"" if kind == ANCHOR else _packed(value[at])
            else:
                said = _coded(high[at], True), low[at].tobytes(), _coded(value[at])
            rows.append((k, batch, kind, *said))
    return _table(rows, [("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("value", pa.binary())])


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _received(messages: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which row each entry came in, and its key and value."""
    rows = [i for i, k in enumerate(messages["kind"].to_pylist()) if k == kind]
    raw = {c: [messages[c][i].as_py() for i in rows] for c in ("high", "low", "value")}
    high = [_decoded(x, np.uint32 if kind in SHORT else np.uint64, True).astype(np.uint64) for x in raw["high"]]
    row = [np.full(len(h), i) for i, h in zip(rows, high, strict=True)]
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    row, high = join(row, np.int64), join(high, np.uint64)
    if kind == ANCHOR:  # each batch is a value of its own; one with several documents counts as two
        several = (high & np.uint64(1)) > 0
        row, high, value = np.concatenate((row, row[several])), np.concatenate((high, high[several])) & ~np.uint64(1), np.concatenate((row, -1 - row[several]))
        return row, high, np.zeros(len(high), np.uint32), value
    if kind == HALF:
        return row, high, np.zeros(len(high), np.uint32), join([_unpacked(x) for x in raw["value"]], np.int64)
    return row, high, join([np.frombuffer(x, np.uint32) for x in raw["low"]], np.uint32), join([_decoded(x, np.int64) for x in raw["value"]], np.int64)


def _meet(messages: pa.Table) -> pa.Table:
    """Replies of one bucket."""
    out, batches, bucket = [], messages["batch"].to_pylist(), messages["bucket"][0].as_py()
    for kind in sorted(set(messages["kind"].to_pylist())):
        row, high, low, value = _received(messages, kind)
        order, runs = firsts(high, low, value)
        sizes = np.diff(np.concatenate((runs, [len(order)])))
        least = np.repeat(value[order[runs]], sizes)
        tell = np.repeat(value[order[runs + sizes - 1]], sizes) > least if kind in SHORT else value[order] > least
        at = order[tell]
        at = at[np.argsort(row[at], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], row[at][1:] != row[at][:-1]))) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=False):
            own, batch = at[a:b], batches[row[at[a]]]
            said = (_coded(np.unique(high[own]).astype(np.uint32), True), b"") if kind in SHORT else (_coded(high[own], True), low[own].tobytes())
            out.append((batch, bucket, kind, *said))
    return _table(out, [("batch", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("high", pa.binary()), ("low", pa.binary())])


def _heard_short(replies: pa.Table, kind: int) -> np.ndarray:
    """The short keys that replies of a kind name, with their bucket, in order."""
    some = replies.filter(pa.compute.equal(replies["kind"], kind))
    keys = [_decoded(x, np.uint32, True).astype(np.uint64) | np.uint64(k << 32) for x, k in zip(some["high"].to_pylist(), some["bucket"].to_pylist(), strict=True)]
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _heard(replies: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that replies of a kind name, by their high parts."""
    some = replies.filter(pa.compute.equal(replies["kind"], kind))
    high = np.concatenate([np.zeros(0, np.uint64), *(_decoded(x, np.uint64, True) for x in some["high"].to_pylist())])
    low = np.frombuffer(b"".join(some["low"].to_pylist()), np.uint32)
    order = np.argsort(high, kind="stable")
    return high[order], low[order]


def _shared(batch: Batch, replies: pa.Table, buckets: int) -> None:
    """Goes on with the anchors that several documents have."""
    batch.choose(among(short(batch.hash, buckets), _heard_short(replies, ANCHOR)))


def _settled(batch: Batch, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shared anchor whether its surroundings are also in a smaller document; and the strings to look at otherwise.

    Another batch's smaller document is smaller than all of this batch that have the key."""
    _shared(batch, replies, buckets)
    high, low = batch.around()
    own = batch.keys[batch.doc]
    gone = (least_of(high, low, own) < own) | among_full(high, low, _heard(replies, AROUND))
    half, look = _heard_short(replies, HALF), []
    for some, h, _ in batch.halves():
        look.append(some[among(short(h, buckets), half) & ~gone[some]])
    return gone, batch.strings(*look)


def _dealt(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents of a partition by batch: ids, lengths, the compressed texts, one after the other, and their anchors as bits."""
    held: dict[int, tuple[list, list]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows, squeeze = [], zstandard.ZstdCompressor(3).compress
        marks = anchors_of([r for _, raws in held.values() for r in raws], length)
        at = 0
        for k, (ids, raws) in held.items():
            n = sum(map(len, raws))
            rows.append((k, ids, [len(r) for r in raws], squeeze(b"".join(raws)), squeeze(np.packbits(marks[at : at + n]).tobytes())))
            at += n
        fields = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], ["batch", "ids", "sizes", "texts", "anchors"])

    for b in batches:
        for k, i, raw in zip(b.column("batch").to_pylist(), b.column("doc_id").to_pylist(), as_bytes(b.column("text").to_pylist()), strict=True):
            ids, raws = held.setdefault(k, ([], []))
            ids.append(i)
            raws.append(raw)
            size += len(raw) + DOCUMENT_BYTES
        if size >= DEALT_BYTES:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


def _batch(t: pa.Table, length: int) -> Batch:
    ids, raws, anchors = [], [], []
    loosen = zstandard.ZstdDecompressor().decompress
    for own, sizes, texts, marks in zip(*(t[c].to_pylist() for c in ("ids", "sizes", "texts", "anchors")), strict=True):
        ids += own
        n, at = sum(sizes), 0
        joined = loosen(texts, max_output_size=max(1, n))
        bits = np.unpackbits(np.frombuffer(loosen(marks, max_output_size=max(1, -(-n // 8))), np.uint8), count=n).view(bool)
        for n in sizes:
            raws.append(joined[at : at + n])
            anchors.append(bits[at : at + n])
            at += n
    return Batch(ids, raws, anchors, length)


def remove_repeats(docs: DataFrame, length: int = LENGTH, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document; see RESULT. spans are byte positions of the removed runs."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = total_bytes(rows, "text", DOCUMENT_BYTES)
    batches, buckets = max(1, -(-size // batch_bytes)), max(1, -(-size // bucket_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"), "doc_id", "text").mapInArrow(lambda parts: _dealt(parts, length), DEALT).groupBy("batch")
    meet = lambda messages: messages.groupBy("bucket").applyInArrow(_meet, REPLIES)

    def anchors(t: pa.Table) -> pa.Table:
        batch = _batch(t, length)
        order = np.argsort(batch.hash)
        h, doc = batch.hash[order], batch.doc[order]
        runs = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(doc, runs) > np.minimum.reduceat(doc, runs) if len(h) else h > 0
        high = short(h[runs], buckets) | several.astype(np.uint64)
        return _sent(t["batch"][0].as_py(), [(ANCHOR, (high, None, None))], buckets)

    def surroundings(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _sent(0, [], buckets)
        batch = _batch(t, length)
        _shared(batch, replies, buckets)
        high, low = batch.around()
        name = (high >> np.uint64(16)).astype(np.int64)
        halves = [(HALF, extremes(short(h, buckets), np.zeros(len(h), np.uint32), name[some])) for some, h, _ in batch.halves()]
        return _sent(t["batch"][0].as_py(), [(AROUND, smallest(high, low, batch.keys[batch.doc])), *halves], buckets)

    def strings(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _sent(0, [], buckets)
        batch = _batch(t, length)
        _, places = _settled(batch, replies, buckets)
        return _sent(t["batch"][0].as_py(), [(STRING, batch.grouped(places))], buckets)

    def cut(t: pa.Table, replies: pa.Table) -> pa.Table:
        done = []
        if t.num_rows:
            batch = _batch(t, length)
            gone, places = _settled(batch, replies, buckets)
            high, low = range_hashes(batch.words, places, np.int64(length), 4)
            own = batch.keys[batch.owner[places]]
            hit = places[(least_of(high, low, own) < own) | among_full(high, low, _heard(replies, STRING))]
            done = batch.covered([(batch.left[gone], batch.right[gone]), (hit, hit + length)])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return _table(done, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", spans)])

    first = meet(dealt.applyInArrow(anchors, MESSAGES))
    second = meet(dealt.cogroup(first.groupBy("batch")).applyInArrow(surroundings, MESSAGES))
    third = meet(dealt.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(strings, MESSAGES))
    return dealt.cogroup(first.unionByName(second).unionByName(third).groupBy("batch")).applyInArrow(cut, RESULT)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows: list[tuple], length: int) -> list[tuple]:
    """Brute force for tests, on (doc_id, text)."""
    raws = as_bytes([t for _, t in rows])
    keys = [LAST if i is None else i for i, _ in rows]
    least: dict[bytes, int] = {}
    for k, raw in zip(keys, raws, strict=True):
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            least[w] = min(k, least.get(w, LAST))
    out = []
    for (i, _), k, raw in zip(rows, keys, raws, strict=True):
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if least[raw[s : s + length]] < k:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out
