"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample: a stretch of at most
``snippet`` characters, from a place that the id chooses, of each of at most ``per_lang`` documents for each language that has
a row to learn from. It labels every byte position: two GRUs read the text forwards and backwards, and a softmax over both
states gives each position's language probabilities. A document's probabilities are the mean over all its positions. Whole
texts are read, many windows of ``window`` bytes side by side; each takes up the states that the ``context`` bytes before it
and after it lead to, by which the part of a state that comes from further away has faded.

Defined results: a null text or one without letters is ``und`` with score 0; without any usable label every text is; rows
with a null lang or doc_id are never learnt from when the id is null or held out; repeated rows are labelled each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import as_bytes, is_held_out, pick, small_batches, stored

HIDDEN = 12
WINDOW = 512
CONTEXT = 64
PER_LANG = 400
SNIPPET = 600
MOST_ROWS = 24_000
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numerals such as a half or a Roman one are none."""
    return text is not None and any(map(str.isalpha, text))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Parameters of both directions: e (256, 3H) input weights with bias for update, reset, candidate; u (H, 2H) and v (H, H)
    recurrent weights; w (2H, C) and b (C) for the position labels."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        r = np.random.default_rng(seed)
        h, self.langs, self.hidden = hidden, langs, hidden
        self.p = {}
        for d in "fb":
            self.p[f"e{d}"] = r.normal(0, 0.4, (256, 3 * h))
            self.p[f"u{d}"] = r.normal(0, h**-0.5, (h, 2 * h))
            self.p[f"v{d}"] = r.normal(0, h**-0.5, (h, h))
        self.p["w"], self.p["b"] = r.normal(0, 0.3, (2 * h, len(langs))), np.zeros(len(langs))
        self.room: dict[str, np.ndarray] = {}

    def _read(self, d: str, x: np.ndarray):
        """States (T, N, H) and what the way back needs, for windows x (T, N) in reading order."""
        e, u, v, n = self.p[f"e{d}"], self.p[f"u{d}"], self.p[f"v{d}"], self.hidden
        h, kept, states = np.zeros((x.shape[1], n)), [], []
        for row in x:
            g = e[row]
            zr = _sigmoid(g[:, : 2 * n] + h @ u)
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(g[:, 2 * n :] + (r * h) @ v)
            kept.append((h, z, r, c))
            h = h + z * (c - h)
            states.append(h)
        return np.stack(states), kept

    def _back(self, d: str, x: np.ndarray, kept, slope: np.ndarray, grad: dict) -> None:
        """Adds the gradients of one direction; slope (T, N, H): those of its states."""
        u, v, n = self.p[f"u{d}"], self.p[f"v{d}"], self.hidden
        ge, gu, gv, dh = np.zeros((256, 3 * n)), np.zeros_like(u), np.zeros_like(v), 0.0
        inputs = []
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = dh + slope[t]
            dc = dh * z * (1 - c * c)
            drh = dc @ v.T
            dz, dr = dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)
            dzr = np.concatenate((dz, dr), 1)
            gv += (r * h).T @ dc
            gu += h.T @ dzr
            inputs.append(np.concatenate((dzr, dc), 1))
            dh = dh * (1 - z) + drh * r + dzr @ u.T
        flat, where = np.concatenate(inputs[::-1]), x.ravel()
        for k in range(3 * n):
            ge[:, k] = np.bincount(where, flat[:, k], 256)
        grad |= {f"e{d}": ge, f"u{d}": gu, f"v{d}": gv}

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions of windows x (T, N) with labels y (N), and its gradients."""
        f, keep_f = self._read("f", x)
        b, keep_b = self._read("b", x[::-1])
        both = np.concatenate((f, b[::-1]), 2)
        logits = both @ self.p["w"] + self.p["b"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        n = np.arange(len(y))
        loss = -np.log(prob[:, n, y] + 1e-12).mean()
        prob[:, n, y] -= 1
        prob /= x.size
        flat = prob.reshape(-1, prob.shape[2])
        grad = {"w": both.reshape(-1, both.shape[2]).T @ flat, "b": flat.sum(0)}
        slope = prob @ self.p["w"].T
        self._back("f", x, keep_f, slope[:, :, : self.hidden], grad)
        self._back("b", x[::-1], keep_b, slope[::-1, :, self.hidden :], grad)
        return loss, grad

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 320, batch: int = 128, width: int = 64, rate: float = 0.02, seed: int = 5) -> ByteGRU:
        """Adam on random windows; every language is drawn equally often."""
        r = np.random.default_rng(seed)
        by = [[np.frombuffer(t, np.uint8) for t, y in zip(texts, labels, strict=True) if y == k and len(t)] for k in range(len(self.langs))]
        present = [k for k, own in enumerate(by) if own]
        if not present:
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            y = r.choice(present, batch)
            x = np.full((batch, width), 32, np.uint8)
            for i, k in enumerate(y):
                own = by[k][r.integers(len(by[k]))]
                a = r.integers(max(1, len(own) - width + 1))
                x[i, : len(own[a : a + width])] = own[a : a + width]
            _, grad = self.step(x.T.astype(np.int64), y)
            size = np.sqrt(sum((g * g).sum() for g in grad.values()))
            now = rate * min(1.0, 1.5 * (1 - t / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(size, 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def _room(self, d: str, *shape: int) -> np.ndarray:
        """Space for the states of a direction, which is used again: new pages cost as much as the arithmetic that fills them."""
        size = int(np.prod(shape))
        if d not in self.room or len(self.room[d]) < size:
            self.room[d] = np.empty(size, np.float32)
        return self.room[d][:size].reshape(shape)

    def _states(self, d: str, x: np.ndarray, here: list[np.ndarray | None], out: np.ndarray) -> None:
        """As _read, for use: fills out with states (T, N, H) in single precision; where here (a row for each step, or None) is 0 the state is zero.

        Each gate has an array (N, H) of its own, so a byte's weights are taken as whole rows and all arithmetic runs over contiguous
        memory."""
        n, f, size = self.hidden, np.float32, x.shape[1]
        e = (self.p[f"e{d}"].reshape(256, 3, n) * np.array([0.5, 0.5, 1])[:, None]).transpose(1, 0, 2).astype(f, order="C")
        u = (self.p[f"u{d}"] * 0.5).reshape(n, 2, n).transpose(1, 0, 2).astype(f, order="C")
        v = (self.p[f"v{d}"] * 0.5).astype(f)
        h, g, a, rh, c = np.zeros((size, n), f), np.empty((3, size, n), f), np.empty((2, size, n), f), np.empty((size, n), f), np.empty((size, n), f)
        for row, there, to in zip(x, here, out, strict=True):
            np.take(e, row, axis=1, out=g, mode="clip")
            np.matmul(h, u, out=a)
            a += g[:2]
            np.tanh(a, out=a)
            a += 1  # twice the gates; v and the last step halve them
            np.multiply(a[1], h, out=rh)
            np.matmul(rh, v, out=c)
            c += g[2]
            np.tanh(c, out=c)
            c -= h
            c *= a[0]
            c *= 0.5
            h = np.add(h, c, out=to)
            if there is not None:
                h *= there[:, None]

    def windows(self, x: np.ndarray, here: list[np.ndarray | None], context: int) -> np.ndarray:
        """Sums (N, C) of the label probabilities of windows x (T, N) over their positions but the first and last ``context``."""
        last, n, f, size, k = len(x) - context, self.hidden, np.float32, x.shape[1], len(self.langs)
        ahead, back = self._room("f", last, size, n), self._room("b", last, size, n)
        self._states("f", x[:last], here[:last], ahead)
        self._states("b", x[context:][::-1], here[context:][::-1], back[::-1])
        ahead, back = ahead[context:], back[: last - context]
        wf, wb = (np.ascontiguousarray(self.p["w"][part].astype(f)) for part in (slice(n), slice(n, None)))
        most = (np.abs(self.p["w"]).sum(0) + np.abs(self.p["b"])).max()  # states lie within -1 and 1
        steps = max(1, 32 // k)
        bias, total, ones = np.tile(self.p["b"].astype(f), (steps * size, 1)), np.zeros((size, k), f), np.ones((k, k), f)
        for t in range(0, len(ahead), steps):
            prob = ahead[t : t + steps].reshape(-1, n) @ wf
            prob += back[t : t + steps].reshape(-1, n) @ wb
            prob += bias[: len(prob)]
            if most > 40:
                np.clip(prob, -40, 40, out=prob)
            np.exp(prob, out=prob)
            prob /= prob @ ones if k <= 16 else prob.sum(1, keepdims=True)  # a product is the faster sum of a few
            prob = prob.reshape(-1, size, k)
            for p, there in zip(prob, here[context + t : context + t + len(prob)], strict=True):
                if there is not None:
                    p *= there[:, None]
            total += prob.sum(0)
        return total

    def documents(self, raws: list[bytes], window: int = WINDOW, context: int = CONTEXT, block: int = 512) -> np.ndarray:
        """Mean label probabilities (documents, C); zero rows for empty texts."""
        out = np.zeros((len(raws), len(self.langs)))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        data = np.concatenate((np.frombuffer(b"".join(raws), np.uint8), np.zeros(1, np.uint8)))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(raws) else np.zeros(0, np.int64)
        full, rest = sizes // window, sizes % window
        doc = np.repeat(np.arange(len(raws)), full)
        at = window * (np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(full)[:-1])), full)) if len(doc) else np.zeros(0, np.int64)
        self._add(out, data, starts, sizes, doc, at, np.full(len(doc), window), context, block)
        doc = np.flatnonzero(rest)
        doc = doc[np.argsort(rest[doc], kind="stable")]
        self._add(out, data, starts, sizes, doc, window * full[doc], rest[doc], context, block)
        return out / np.maximum(sizes, 1)[:, None]

    def _add(self, out: np.ndarray, data, starts, sizes, doc, at, width, context: int, block: int) -> None:
        """Adds the windows of the documents doc, from byte at and of the given widths, to their rows."""
        for k in range(0, len(doc), block):
            d, a, w = doc[k : k + block], at[k : k + block], width[k : k + block]
            place = a + np.arange(-context, int(w.max()) + context)[:, None]
            inside = (place >= 0) & (place < sizes[d])
            here = [None if row.all() else row.astype(np.float32) for row in inside]
            x = data[np.where(inside, starts[d] + place, len(data) - 1)].astype(np.intp)
            np.add.at(out, d, self.windows(x, here, context))


def fit(docs: DataFrame, per_lang: int = PER_LANG, snippet: int = SNIPPET, most: int = MOST_ROWS) -> ByteGRU | None:
    """Trains on documents that are not held out; None if no document has a language. At most ``per_lang`` stretches of a language, and
    ``most`` in all (or one of each language, if there are more of these), come to the driver.

    Rows are drawn by the hash of id and text, as many of each language as it may have, and the smallest hash of each always; copies
    of a row count once."""
    rows = pick(docs, doc_id="long", text="string", lang="string")
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"), 3, 1) & (F.length("text") > 0))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "languages")
    names = counts.rows.count()
    if not names:
        return None
    each = max(1, min(per_lang, most // names))
    drawn = F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < 2.0 * each / F.col("n")
    start = 1 + F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.length("text") - snippet, F.lit(1)))
    small_batches(docs.sparkSession)
    some = rows.join(counts.rows, "lang").filter(drawn | (F.col("h") == F.col("least")))
    some = some.select("lang", "h", F.substring("text", start.cast("int"), F.lit(snippet)).alias("text")).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))  # about 2 * each rows a language
    got = some.withColumn("rank", rank).filter(F.col("rank") <= each).orderBy("lang", "rank").collect()
    counts.drop()
    langs = sorted({r["lang"] for r in got})
    place = {lang: k for k, lang in enumerate(langs)}
    return ByteGRU(langs).train([r["text"].encode("utf-8", "surrogatepass") for r in got], np.array([place[r["lang"]] for r in got]))


def label(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    small_batches(docs.sparkSession, 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, net = b.column("text").to_pylist(), sent.value
            lettered = [net is not None and has_letter(t) for t in texts]
            prob = net.documents([r if ok else b"" for r, ok in zip(as_bytes(texts), lettered, strict=True)]) if net is not None else np.zeros((len(texts), 1))
            at = prob.argmax(1)
            names = [net.langs[k] if ok else UNKNOWN for k, ok in zip(at, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.clip(prob.max(1), 0, 1) * np.array(lettered, bool), pa.float64())], ["doc_id", "lang_pred", "score"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = label(docs, fit(docs, per_lang))
    return found.select("doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
