"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown in numpy on a bounded sample of labelled documents (``max_rows``, documented bound) and flattened
into arrays (feature, bin, left, right, value), which the executors walk for a whole batch at a time.

Defined results: a null text counts as empty; empty texts get a score like any other; a label without a document and
a document without a label are no examples; repeated rows are scored each; an empty table gives an empty result;
without examples of both labels every score is the share of label 1 (0.5 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import as_bytes, is_held_out, pick, small_batches

MAX_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "spaces", "punctuation", "symbols", "non_ascii",
    "lines_log", "line_length", "repeated_lines", "distinct_words", "top_word", "capital_words", "exclaimed", "piped", "long_words",
    "sentence_ends", "byte_entropy",
)

_CLASS = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 sentence punctuation, 5 symbol, 6 newline, 7 non-ASCII
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 6 if _ch == "\n" else 0 if _ch.islower() else 1 if _ch.isupper() else 2 if _ch.isdigit() else 3 if _ch.isspace() or _c < 32 else 4 if _ch in ".,;:'\"-()!?" else 5


def features(texts) -> np.ndarray:
    """One row of statistics per text; whole texts are read."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, raw in enumerate(as_bytes(texts)):
        n = len(raw)
        if not n:
            continue
        by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        c = np.bincount(_CLASS, by_byte, 8)
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        k, m = max(1, len(words)), max(1, len(lines))
        counts: dict = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        p = by_byte[by_byte > 0] / n
        out[i] = (
            np.log1p(n), np.log1p(len(words)), (n - c[3] - c[6]) / k, (c[0] + c[1]) / n, c[1] / max(1, c[0] + c[1]), c[2] / n, c[3] / n,
            c[4] / n, c[5] / n, c[7] / n, np.log1p(len(lines)), n / m, 1 - len(set(lines)) / m, len(counts) / k, max(counts.values(), default=0) / k,
            sum(map(bytes.isupper, words)) / k, by_byte[33] / k, by_byte[124] / k, sum(len(w) > 24 for w in counts) / max(1, len(counts)),
            (by_byte[46] + by_byte[33] + by_byte[63]) / k, -float((p * np.log2(p)).sum()),
        )
    return out


class BoostedTrees:
    """Binary logistic boosting on feature histograms; every node of every tree lies in five flat arrays."""

    def __init__(self, rounds: int = 80, depth: int = 5, bins: int = 64, rate: float = 0.15, least: float = 4.0, ridge: float = 1.0):
        self.rounds, self.depth, self.bins, self.rate, self.least, self.ridge = rounds, depth, bins, rate, least, ridge
        self.edges: list[np.ndarray] = []
        self.roots = np.zeros(0, np.int32)
        self.feature = self.cut = self.left = self.right = np.zeros(0, np.int32)
        self.value = np.zeros(0)
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int32) if len(self.edges) else np.zeros(x.shape, np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(y.mean()) if len(y) else 0.5
        self.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, raw, nodes, roots = self.binned(x), np.full(len(y), self.base), [], []
        flat = b + np.arange(x.shape[1], dtype=np.int32) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            roots.append(len(nodes))
            self._grow(flat, b, p - y, p * (1 - p), np.arange(len(y)), 0, nodes, raw)
        self.roots = np.array(roots, np.int32)
        self.feature, self.cut, self.left, self.right = (np.array([n[i] for n in nodes], np.int32) for i in range(4))
        self.value = np.array([n[4] for n in nodes])
        return self

    def _grow(self, flat, b, g, h, rows, level, nodes, raw) -> int:
        at, sg, sh = len(nodes), g[rows].sum(), h[rows].sum()
        value = -self.rate * sg / (sh + self.ridge)
        nodes.append([0, 0, at, at, value])
        best = (1e-6, -1, -1)
        if level < self.depth and sh > 2 * self.least / 10:
            size, k = flat.shape[1] * self.bins, flat.shape[1]
            where = flat[rows].ravel()
            hg = np.bincount(where, np.repeat(g[rows], k), size).reshape(k, self.bins).cumsum(1)
            hh = np.bincount(where, np.repeat(h[rows], k), size).reshape(k, self.bins).cumsum(1)
            n = np.bincount(where, minlength=size).reshape(k, self.bins).cumsum(1)
            gain = hg**2 / (hh + self.ridge) + (sg - hg) ** 2 / (sh - hh + self.ridge) - sg**2 / (sh + self.ridge)
            gain[(n < self.least) | (len(rows) - n < self.least)] = 0
            j = int(gain.argmax())
            best = (gain.flat[j], j // self.bins, j % self.bins)
        if best[1] < 0 or best[0] <= 1e-6:
            raw[rows] += value
            return at
        low = b[rows, best[1]] <= best[2]
        nodes[at][:2] = best[1:]
        nodes[at][2] = self._grow(flat, b, g, h, rows[low], level + 1, nodes, raw)
        nodes[at][3] = self._grow(flat, b, g, h, rows[~low], level + 1, nodes, raw)
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        """All rows step down all trees at once; a leaf points to itself."""
        raw = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            b, rows = self.binned(x), np.arange(len(x))[:, None]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            for _ in range(self.depth):
                at = np.where(b[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            raw += self.value[at].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> BoostedTrees:
    """Trees from at most ``max_rows`` labelled rows that have a document, those with the smallest hash of doc_id, none held out."""
    marks = pick(labels, doc_id="long", quality="int").filter("doc_id is not null and quality in (0, 1)")
    marks = marks.join(pick(docs, doc_id="long"), "doc_id", "left_semi")  # labels without documents take no place
    marks = marks.filter(~is_held_out(F.col("doc_id"), 4, 2)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    marks = marks.groupBy("doc_id").agg(F.collect_list("quality").alias("marks"))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("marks"), pa.array(x.tolist(), pa.list_(pa.float32()))], ["doc_id", "marks", "x"])

    small_batches(docs.sparkSession)
    sample = pick(docs, doc_id="long", text="string").join(F.broadcast(marks), "doc_id")  # at most max_rows ids
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("marks").alias("marks"))  # and as many rows
    rows = sample.mapInArrow(stats, "doc_id long, marks array<int>, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    x = [v for v, m in zip(rows["x"], rows["marks"], strict=True) for _ in m]
    y = [q for m in rows["marks"] for q in m]
    return BoostedTrees().fit(np.array(x, np.float32).reshape(-1, len(FEATURES)), np.array(y, float))


def score(docs: DataFrame, model: BoostedTrees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with a column score from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of nodes
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.scores(features(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*map(b.column, keep), pa.array(found)], [*keep, "score"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, max_rows)
    found = score(pick(docs, doc_id="long", text="string"), model)
    return found.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
