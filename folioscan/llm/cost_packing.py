"""Cost-balanced packing of tokenised documents into sequences of bounded length.

Cost of a piece of n tokens: ``linear * n + quadratic * n**2`` (attention inside the piece). Within a block of
documents, pieces go in descending length to the sequence of lowest cost that has room; what no sequence can hold is
cut to fill the cheapest open one, so a block's sequences are full but for the last. A document longer than a sequence
is first cut into whole sequences. Blocks are formed inside each input partition, in row order, so nothing is
shuffled and a lost executor only repeats its partitions.

Defined results: a null text is an empty one and gives its end token alone; null and repeated ids are packed like any
other row; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folioscan.llm.common import pick, small_batches

LENGTH = 4096
END = 2
BLOCK_TOKENS = 1 << 20
CACHE_WORDS = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, cost double"


#: Letters whose lower case is one letter wherever they stand and that normal forms leave alone, and the stops after them.
_LETTERS = "".join(chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº")
_PLAIN, _STOPS = re.compile(f"[{_LETTERS}]+"), ".,;:!?"


class WordTokens:
    """Ids of texts as the tokenizer gives them. Its pieces never span ASCII white space and no step of it looks across one, so
    a text's ids are those of its chunks between white space, one after the other. A plain word goes to the tokenizer in lower
    case and without the stops after it, which are a piece of their own; any other chunk goes as it is. The stores of ids are
    emptied at ``most`` entries, which changes speed only."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.most = Tokenizer.from_file(path), most
        self.bare = Tokenizer(self.whole.model)  # without its other steps, for words that are as these would leave them
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _LETTERS.lower()}
        vocabulary = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[n for w, n in vocabulary.items() if w.endswith("</w>")]] = True
        self._clear()
        probe = ["x" + c + "y" for c in _LETTERS]
        self.plain = self._words([w.lower() for w in probe]) == self._chunks(probe) == self._chunks([w.lower() for w in probe])

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case plain letters: many at a time, straight to the model."""
        out = []
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            found = self.bare.encode_batch_fast([" ".join(some).translate(self.letters)], add_special_tokens=False)[0]
            ids = np.array(found.ids, np.uint32)
            ends, ids = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist(), ids.tobytes()
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(chunks), 20_000):
            out += [np.array(e.ids, np.uint32).tobytes() for e in self.whole.encode_batch_fast(chunks[k : k + 20_000], add_special_tokens=False)]
        return out

    def _numbers(self, strings: pa.Array) -> np.ndarray:
        """Each string's place in the store; unknown ones are learnt."""
        coded = strings.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # without a scalar object for each
        found = list(map(self.number.get, known))
        fresh = [c for c, n in zip(known, found, strict=True) if n is None]
        if fresh:
            words = [w for w in fresh if self.plain and _PLAIN.fullmatch(w)]
            plain = set(words)
            others = [c for c in fresh if c not in plain]
            own, first = self._words(words) + self._chunks(others), len(self.ends) - 1
            self.number.update(zip(words + others, range(first, first + len(own)), strict=True))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(x) // 4 for x in own])))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(own), np.uint32)))
            found = list(map(self.number.get, known))
        return np.array(found, np.int64)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other and without special tokens, and where each text's begin (and the last ends)."""
        if len(self.number) > self.most or len(self.ids) > 4 * self.most:
            self._clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        chunk = coded.dictionary
        stem = pc.utf8_rtrim(chunk, _STOPS)
        plain = pc.match_substring_regex(stem, f"^[{_LETTERS}]+$") if self.plain else pa.repeat(False, len(chunk))
        stops = pc.if_else(plain, pc.utf8_ltrim(chunk, _LETTERS), "")
        stem = pc.if_else(plain, pc.utf8_lower(stem), chunk)
        part = np.stack((self._numbers(stem), self._numbers(stops)), 1)[coded.indices.to_numpy()].ravel()
        size = self.ends[part + 1] - self.ends[part]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.ends[part] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[2 * bounds]


_READY: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One per Python worker."""
    if path not in _READY:
        _READY[path] = WordTokens(path)
    return _READY[path]


def cost_of(n, linear: float, quadratic: float):
    return linear * n + quadratic * n * n


def assign(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0 / LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for the documents of one block."""
    out, rests, sequences = [], [], 0
    for d, n in enumerate(lengths):
        full = n // size
        for k in range(full):
            out.append((d, k * size, size, sequences, 0))
            sequences += 1
        if n - full * size:
            rests.append((n - full * size, d, full * size))
    rests.sort(key=lambda r: (-r[0], r[1]))
    room = [size] * -(-sum(r[0] for r in rests) // size)
    if room:  # the last sequence is as short as the rest of the tokens
        room[-1] -= size * len(room) - sum(r[0] for r in rests)
    held = list(room)
    cheapest = [(0.0, s) for s in range(len(room))]
    heapq.heapify(cheapest)
    for n, d, start in rests:
        while n:
            tried, found = [], None
            while cheapest:
                cost, s = heapq.heappop(cheapest)
                if held[s] >= n:
                    found = (cost, s, n)
                    break
                tried.append((cost, s))
            if found is None:  # no room in one piece: fill the cheapest open sequence and go on with what is left
                cost, s = tried.pop(0)
                found = (cost, s, held[s])
            for x in tried:
                heapq.heappush(cheapest, x)
            cost, s, part = found
            out.append((d, start, part, sequences + s, room[s] - held[s]))
            held[s] -= part
            start, n = start + part, n - part
            if held[s]:
                heapq.heappush(cheapest, (cost + cost_of(part, linear, quadratic), s))
    return out


def padded(n: int, size: int) -> int:
    """Sequences are padded to ``size``, or to the power of two that holds them if they are short."""
    return min(size, 1 << max(0, n - 1).bit_length())


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, block_tokens: int = BLOCK_TOKENS, linear: float = 1.0, quadratic: float = 1.0 / LENGTH) -> DataFrame:
    """One row per piece; see PIECES. ``tokenizer``: path of a tokenizer file that every executor has."""
    if docs.schema["text"].dataType.simpleString() != "string":
        raise TypeError("text must be a string column")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, blocks = tokens_of(tokenizer), TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[bytes] = []
        held = 0
        last = np.array([end], "<u4").tobytes()

        def block() -> pa.RecordBatch:
            rows = assign([len(t) // 4 for t in tokens], length, linear, quadratic)
            used: dict[int, int] = {}
            cost: dict[int, float] = {}
            for _, _, n, s, _ in rows:
                used[s] = used.get(s, 0) + n
                cost[s] = cost.get(s, 0.0) + cost_of(n, linear, quadratic)
            first = (part << 40) + (blocks << 20)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()), "start": [r[1] for r in rows], "length": [r[2] for r in rows],
                "ids_crc32": [zlib.crc32(memoryview(tokens[d])[4 * a : 4 * (a + n)]) for d, a, n, _, _ in rows], "doc_tokens": [len(tokens[r[0]]) // 4 for r in rows],
                "sequence_id": [first + r[3] for r in rows], "offset": [r[4] for r in rows], "padded_to": [padded(used[r[3]], length) for r in rows], "cost": [cost[r[3]] for r in rows],
            })

        for b in batches:
            found, bounds = words.encode(b.column("text"))
            for i, lo, hi in zip(b.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids.append(i)
                tokens.append(found[lo:hi].astype("<u4").tobytes() + last)
                held += hi - lo + 1
                if held >= block_tokens:
                    yield block()
                    ids.clear(), tokens.clear()
                    held, blocks = 0, blocks + 1
        if ids:
            yield block()

    return pick(docs, doc_id="long", text="string").mapInArrow(run, PIECES)
