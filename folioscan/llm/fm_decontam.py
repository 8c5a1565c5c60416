"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of about ``shard_bytes``. A shard's words become ids of the benchmark's
vocabulary; stretches with fewer known words in a row than the shortest window cannot hold one and are left out, the rest
is joined with separators that sort by position. Over that sequence stand a suffix order (prefix doubling), its
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled every ``sample`` words and at each stretch's start.
All windows are searched backward at once; their rows walk to sampled positions, and the covered words are merged to spans.

The benchmark reaches the tasks in blocks of at most about ``block_bytes`` of text, each block one more pass over the documents.

Defined results: null texts have no words; an item without words has no window; items that share an id are one item; a
null item_id counts as the id ''; repeated documents are judged each; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import as_bytes, only, pick, small_batches, stored, total_bytes

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
SAMPLE = 4
ADDED = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"

#: ASCII letters in lower case, digits and bytes above 127 stay; all else parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class Phrases:
    """Distinct windows of some benchmark items, as ids of their own vocabulary (from 1)."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids: dict[bytes, int] = {}
        self.owners: list[list[str]] = []
        seen: dict[tuple, int] = {}
        for name, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(as_bytes([text])[0])]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                k = seen.setdefault(tuple(w[i : i + window]), len(seen))
                if k == len(self.owners):
                    self.owners.append([])
                if name not in self.owners[k][-1:]:
                    self.owners[k].append(name)
        self.lengths = np.array([len(p) for p in seen], np.int64)
        self.shortest = int(self.lengths.min()) if seen else 0
        self.words = np.zeros((len(seen), window), np.int64)  # aligned at the end: column -1 is the last word
        for k, p in enumerate(seen):
            self.words[k, window - len(p) :] = p


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Positions by suffix. Prefix doubling on integer ranks; the last rank must be unique, so no suffix runs out."""
    n = len(ranks)
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable" if n < 64 else None)
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Access and rank on an integer sequence, for whole arrays of positions."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(np.int32)
            self.levels.append((bit, np.concatenate((np.zeros(1, np.int32), np.cumsum(ones, dtype=np.int32)))))
            self.zeros.append(int(len(values) - ones.sum()))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before position i."""
        p = np.zeros_like(i)
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            one = (symbol >> bit & 1).astype(bool)
            i, p = np.where(one, zeros + ones[i], i - ones[i]), np.where(one, zeros + ones[p], p - ones[p])
        return i - p

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            one = ones[i + 1] > ones[i]
            symbol |= one.astype(symbol.dtype) << bit
            i = np.where(one, zeros + ones[i], i - ones[i])
        return symbol


class FMIndex:
    """Of a sequence of ids from 1 to top, with 0 as separator, also at the end."""

    def __init__(self, sequence: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(sequence)
        ends = sequence == 0
        ranks = np.where(ends, np.cumsum(ends), sequence + int(ends.sum()))
        order = suffix_order(ranks)
        before = sequence[order - 1]  # of the first position: the last, a separator
        self.tree = WaveletMatrix(before, top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=top + 1))))
        marked = (order % sample == 0) | (before == 0)
        self.marked, self.at, self.positions, self.size = marked, np.cumsum(marked) - 1, order[marked], n

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of every phrase, by backward search; phrases are aligned at their ends."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64)
        for step in range(words.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            w = words[live, -1 - step]
            low[live], high[live] = self.first[w] + self.tree.rank(w, low[live]), self.first[w] + self.tree.rank(w, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, by steps to sampled suffixes."""
        out, back = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.marked[rows[left]]
            hit = left[done]
            out[hit] = self.positions[self.at[rows[hit]]] + back[hit]
            left = left[~done]
            if len(left):
                symbol = self.tree.access(rows[left])
                rows[left] = self.first[symbol] + self.tree.rank(symbol, rows[left])
                back[left] += 1
        return out


def occurrences(documents: list[list[bytes]], phrases: Phrases, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position over all documents, phrase) of every occurrence, and where each document starts."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    none = np.zeros(0, np.int64)
    if not len(phrases.words) or not starts[-1]:
        return none, none, starts
    get = phrases.ids.get
    ids = np.fromiter((get(w, 0) for d in documents for w in d), np.int64, starts[-1])
    edge = np.zeros(len(ids) + 1, bool)
    edge[starts] = True
    known = ids > 0
    opens = known & (edge[:-1] | ~np.concatenate(([False], known[:-1])))
    closes = known & (edge[1:] | ~np.concatenate((known[1:], [False])))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long_enough = b - a >= phrases.shortest
    a, b = a[long_enough], b[long_enough]
    if not len(a):
        return none, none, starts
    kept = np.repeat(a - np.concatenate(([0], np.cumsum(b - a + 1)[:-1])), b - a + 1) + np.arange((b - a + 1).sum())
    last = np.cumsum(b - a + 1) - 1
    sequence = ids[np.minimum(kept, len(ids) - 1)]
    sequence[last] = 0
    index = FMIndex(sequence, len(phrases.ids), sample)
    low, high = index.search(phrases.words, phrases.lengths)
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return kept[index.locate(rows)], np.repeat(hit, n), starts


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    """Batches in tables of about shard_bytes; one batch may be larger than that."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= shard_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pass(docs: DataFrame, sent, shard_bytes: int) -> DataFrame:
    """Adds what a block of phrases hits; only the texts, spans and items become Python objects."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            documents = [words_of(t) for t in as_bytes(shard["text"].to_pylist())]
            at, which, starts = occurrences(documents, sent.value)
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            if len(at):
                doc = np.searchsorted(starts, at, side="right") - 1
                cover = np.zeros(starts[-1] + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + sent.value.lengths[which], -1)
                deep = np.cumsum(cover)
                first = (deep > 0) & (np.concatenate(([0], deep[:-1])) == 0)
                edge = np.zeros(starts[-1] + 1, bool)
                edge[starts] = True
                first |= (deep > 0) & edge
                after = (deep[:-1] > 0) & ((deep[1:] == 0) | edge[1:])
                for a, b in zip(np.flatnonzero(first).tolist(), (np.flatnonzero(after) + 1).tolist(), strict=True):
                    d = int(np.searchsorted(starts, a, side="right")) - 1
                    spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
                for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                    items.setdefault(d, set()).update(sent.value.owners[w])
            full = [_merged([*((s["start"], s["end"]) for s in had), *spans.get(d, [])]) for d, had in enumerate(shard["spans"].to_pylist())]
            added = [
                pa.array([len(x) for x in documents], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in full], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted({*had, *items.get(d, ())}) for d, had in enumerate(shard["items"].to_pylist())], pa.list_(pa.string())),
            ]
            yield from pa.table([*shard.columns[:-3], *added], names=names).to_batches()

    return docs.mapInArrow(run, docs.schema)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs (with a string column text; n_words, spans and items are replaced), n_words, spans (merged, in words,
    end exclusive) and items (sorted ids) of every document."""
    small_batches(docs.sparkSession)
    items = pick(benchmark, item_id="string", text="string").filter("text is not null").select(F.coalesce("item_id", F.lit("")).alias("item_id"), "text")
    blocks = -(-total_bytes(items, "text") // block_bytes) or 1
    empty = [F.lit(0).cast("long"), F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>")]
    names = [x.split(" ")[0] for x in ADDED.split(", ")]
    texts = [c for c in docs.columns if c == "text" or c.lower() not in (*names, "text")]  # a column TEXT beside text is left out
    own = [t if t == "text" else f"_{i}" for i, t in enumerate(texts)]  # names may clash but for case; they come back at the end
    found = only(docs, *texts).toDF(*own).select("*", *[e.alias(n) for n, e in zip(names, empty, strict=True)])
    last = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        phrases = Phrases(sorted((r.item_id, r.text) for r in part.collect()), window)  # bounded by the block
        sent = docs.sparkSession.sparkContext.broadcast(phrases)
        found = _pass(found, sent, shard_bytes)
        if k < blocks - 1:  # workers and driver hold one block at a time
            held = stored(found, "pass")
            sent.destroy()
            if last:
                last.drop()
            found, last = held.rows, held
    return found.toDF(*texts, *names)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    raw = as_bytes([text])[0]
    at = [m.span() for m in _WORD.finditer(raw.translate(_WORDS))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def verdicts(found: DataFrame) -> DataFrame:
    """Counts, items and the verdict: at least one word in twenty is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = found.withColumn("n_hit", hit)
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    rows = verdicts(only(found, "doc_id", "n_words", "spans", "items"))  # other columns may clash with these but for case
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def plain(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Brute force for tests: words, words hit, items."""
    words, hit, found = words_of(as_bytes([text])[0]), set(), set()
    for name, t in items:
        w = words_of(as_bytes([t])[0])
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(name or "")
    return len(words), len(hit), sorted(found)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
