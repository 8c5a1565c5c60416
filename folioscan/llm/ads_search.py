"""Approximate nearest neighbours by largest inner product, with an adaptive scan of dimensions.

Vectors are turned by one random rotation and dealt to inverted lists around centroids, which are fitted to a bounded
sample (``sample`` vectors). A query probes the lists whose centroids have the largest inner product with it; how many is
measured on the sample, so that the probed lists hold a share ``found`` of the true neighbours there: few where vectors form
clusters, most where they do not. Within a list the rotated vectors lie in column blocks: after each block of dimensions the
squared distance so far between the directions of candidate and query is held against the share that a random rotation
leaves there, ``sigmas`` deviations above its mean, of the distance at which the query's current k-th best score is reached;
candidates beyond it are abandoned. Survivors are scored with their original components in double precision.

A query first scans the nearest list; the k-th best score found there is its bar in the other lists. Every answer comes from
such a scan: the sample only fits the centroids and the number of lists to probe.

Large lists are cut into blocks of about ``block`` vectors, each with the list's queries in blocks of as many, so a list
that holds a third of all vectors is many tasks. Each gives k rows a query at most; the last step keeps the k best.

Defined results: vectors that are null, zero, of another length than most vectors, or that hold null or non-finite
components take no part; null ids take no part; equal scores go to the smaller vec_id; a vec_id that repeats with other
rows is a candidate once per different vector, and as a query gets one list, the best for any of its vectors; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import pick, small_batches, written

K = 20
EVERY = 20
SAMPLE = 20_000
LIST_SIZE = 1024
MOST_LISTS = 4096
FOUND = 0.97
SIGMAS = 3.0
COLUMNS = 16
BLOCK = 2048


class Lists:
    """The rotation and the centroids: all that an executor needs to place a vector."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 12):
        r = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(r.normal(size=(sample.shape[1], sample.shape[1])))[0].astype(np.float32)
        x = sample.astype(np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.centroids = unit[r.choice(len(unit), min(lists, len(unit)), replace=False)]
        for _ in range(rounds):
            own = self.place(unit)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, unit)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), self.centroids)

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[k : k + 4096] @ self.centroids.T).argmax(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def needed(self, x: np.ndarray, k: int, found: float, queries: int = 256) -> int:
        """The fewest lists to probe that hold a share found of the true neighbours, by brute force on some vectors of x."""
        if len(x) < 2:
            return len(self.centroids)
        q = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)
        scores = x[q] @ x.T
        scores[np.arange(len(q)), q] = -np.inf
        n = min(k, len(x) - 1)
        near = self.place(x)[np.argpartition(-scores, n - 1, axis=1)[:, :n]]
        place = np.argsort(np.argsort(-(x[q] @ self.centroids.T), axis=1, kind="stable"), axis=1)
        return int(np.quantile(np.take_along_axis(place, near, axis=1), found, method="higher")) + 1

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The lists with the nearest centroids, nearest first."""
        n, near = min(probes, len(self.centroids)), -(x @ self.centroids.T)
        at = np.argpartition(near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(at, np.argsort(np.take_along_axis(near, at, axis=1), axis=1, kind="stable"), axis=1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def share(done: int, d: int, sigmas: float) -> float:
    """The largest share of a squared length that done of d randomly rotated dimensions are taken to hold: sigmas deviations over the mean."""
    return min(1.0, done / d + sigmas * float(np.sqrt(2 * done * (d - done) / (d * d * (d + 2)))))


def scan(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, rotation: np.ndarray, k: int = K, sigmas: float = SIGMAS, columns: int = COLUMNS, bars: np.ndarray | None = None):
    """(query, place, score) of vectors that reach each query's bar, 512 vectors at a time, abandoned ones left out. own: the queries' ids.

    The difference e of the directions of query and vector has a squared length of at most 2 - 2 bar / (|q| |x|) if the vector
    reaches the bar, and of it share() lies in the first dimensions: what shows more there is abandoned. All pairs get a
    further block at once, by a matrix product, until few are left. Send the k-th best scores so far to raise the bars."""
    d = vectors.shape[1]
    long_q, long_x = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1)
    q, x = (queries / long_q[:, None]).astype(np.float32) @ rotation, (vectors / long_x[:, None]).astype(np.float32) @ rotation
    cuts = [*range(columns, d, columns), d]
    half_q = {c: (q[:, :c] ** 2).sum(1) / 2 - share(c, d, sigmas) - np.float32(2e-5) for c in cuts}
    half_x = {c: (x[:, :c] ** 2).sum(1) / 2 for c in cuts}
    seeds = queries @ vectors[: 4 * k].T
    seeds[ids[None, : 4 * k] == own[:, None]] = -np.inf
    bar = np.sort(seeds, axis=1)[:, -k] if seeds.shape[1] >= k else np.full(len(q), -np.inf)
    bar = bar if bars is None else np.maximum(bar, bars)
    for lo in range(0, len(x), 512):
        hi, done, part = min(len(x), lo + 512), 0, np.float32(0)
        at = bar / long_q
        for c in cuts:
            part = part + q[:, done:c] @ x[lo:hi, done:c].T
            done = c
            keep = part >= half_q[c][:, None] + half_x[c][None, lo:hi] + (share(c, d, sigmas) * at)[:, None] / long_x[None, lo:hi]
            if 8 * np.count_nonzero(keep) <= keep.size:
                break
        keep &= ids[None, lo:hi] != own[:, None]
        i, j = np.nonzero(keep)
        part, j = part[i, j], j + lo
        while done < d and len(i):
            c = min(done + columns, d)
            part = part + np.einsum("ij,ij->i", q[i, done:c], x[j, done:c])
            done = c
            keep = part >= half_q[c][i] + half_x[c][j] + share(c, d, sigmas) * at[i] / long_x[j]
            i, j, part = i[keep], j[keep], part[keep]
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", queries[i[n : n + 65536]], vectors[j[n : n + 65536]]) for n in range(0, len(i), 65536))])
        good = score >= bar[i] - 1e-9 * long_q[i] * long_x[j]
        higher = yield i[good], j[good], score[good]
        bar = bar if higher is None else np.maximum(bar, higher)


def scanned(queries, vectors, ids, own, rotation, k: int = K, sigmas: float = SIGMAS, columns: int = COLUMNS, bars=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of what scan leaves, by query; equal scores go to smaller ids."""
    i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    parts, bar = scan(queries, vectors, ids, own, rotation, k, sigmas, columns, bars), None
    while True:
        try:
            more = parts.send(bar)
        except StopIteration:
            return i, j, s
        i, j, s = (np.concatenate(two) for two in zip((i, j, s), more, strict=True))
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, s, rank = i[rank < k], j[rank < k], s[rank < k], rank[rank < k]
        bar = np.full(len(queries), -np.inf)
        bar[i[rank == k - 1]] = s[rank == k - 1]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of doubles), only what takes part."""
    rows = pick(vectors, vec_id="long", embedding="array<double>").filter("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(~bad & F.exists("embedding", lambda v: v != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == (size[0]["d"] if size else 0)).select("vec_id", F.col("embedding").alias("x")).distinct()


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, is_query: Column, k: int = K, probes: int | None = None, found: float = FOUND, sample: int = SAMPLE, block: int = BLOCK, sigmas: float = SIGMAS) -> DataFrame:
    """query_id, rank, vec_id, score for the k nearest found of every row that is_query (a condition on vec_id) selects."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = written(usable(vectors), "vectors")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).toPandas()  # at most sample vectors
    total = rows.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    fitted = _matrix(some["x"])
    lists = Lists(fitted, max(1, min(MOST_LISTS, total // LIST_SIZE)))
    probes = probes or lists.needed(fitted, k, found)
    sent = spark.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist()).reshape(b.num_rows, -1)
            at = sent.value.place(x) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], ["vec_id", "x", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("x").to_pylist()).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.probe(x, probes).tolist(), pa.list_(pa.int64()))], ["vec_id", "x", "lists"])

    placed = written(rows.mapInArrow(place, "vec_id long, x array<double>, list long"), "placed")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row per list
    queries = written(rows.filter(is_query).mapInArrow(probe, "vec_id long, x array<double>, lists array<long>"), "queries")

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if left.empty or right.empty:
            return none
        own, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        i, j, s = scanned(_matrix(left["x"]), _matrix(right["x"]), ids, own, sent.value.rotation, k, sigmas, bars=left["bar"].to_numpy())
        return pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": s})

    def scans(asked: DataFrame) -> DataFrame:
        """The k best of each part of a list, for queries (vec_id, x, bar) and the list that each asks."""
        asked = asked.join(F.broadcast(sizes), "list")
        per_list = asked.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("shares"))  # a row per list
        asked = asked.join(F.broadcast(per_list), "list").withColumn("share", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shares")).cast("int"))
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "share", "vec_id", "x", "bar")
        held = placed.join(F.broadcast(sizes), "list").join(F.broadcast(per_list), "list")
        held = held.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.col("blocks")).cast("int"))
        held = held.select("list", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "vec_id", "x")
        at = ["list", "block", "share"]
        return asked.groupBy(*at).cogroup(held.groupBy(*at)).applyInPandas(near, "query_id long, vec_id long, score double")

    first = written(scans(queries.select("vec_id", "x", F.lit(float("-inf")).alias("bar"), F.element_at("lists", 1).alias("list"))), "first-scans")
    best_first = first.select("query_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))).alias("n")).filter(F.col("n") == k)
    bars = queries.join(best_first.select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar")), "vec_id", "left")
    rest = bars.select("vec_id", "x", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"), F.explode(F.slice("lists", 2, F.size("lists"))).alias("list"))
    near_ones = first.unionByName(scans(rest)) if probes > 1 else first
    near_ones = near_ones.distinct()  # an id with several vectors may meet the same candidate again
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near_ones.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def multiples(every: int = EVERY) -> Column:
    return F.col("vec_id") % every == 0
