"""Prefix trie of rebuilt conversations by heavy-path decomposition.

A conversation c takes the first h turns of conversation c - c % 100 (all it has, if fewer) and goes on with its own turns after
its first h, h being crc32(decimal c) % 6. Every distinct sequence of the first d rebuilt turns is a node; its members are the
conversations that begin with it, its name is the smallest of them and its depth.

1. Turns get their places by ranges, and a prefix is the XOR of 128-bit hashes of its turns with their depths, which is summed in
   stretches of 1,024 turns, so a conversation of any length is many tasks.
2. Nodes, members and children are counted by grouping. A node's largest child, by members, goes on its heavy path; every other
   child begins a path of its own and has at most half of the members, so no node lies below more than log2(members) of these.
3. The head of each node's path and the number of paths above are running values along the conversations that name nodes.
4. Round by round, from the paths with most others above them up to the root's, own values and those of light children are summed
   from the lower end of each path, in stretches again, and the heads' sums go to the parents. Every node is in one round.

Ids of the conversations that end at a node are joined to pieces in ranges, and the pieces are hashed one after the other.

Defined results: null turns come first; rows of the same turn follow role, then the MD5 of their text, and equal rows are turns
each; a null role or text is empty; rows without conv_id belong to no conversation and are left out; conversations without turns
after rebuilding end at the root; an empty table has no nodes. Two prefixes are held for equal if their 128 bits agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import Stored, crc32_sql, pick, placed, stored

FAMILY, HEADS = 100, 6
STRETCH = 1024
PIECE_BYTES = 1 << 16
KEY = ["k1", "k2", "depth"]
FOUND = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(turns: DataFrame) -> Stored:
    """conv_id, a and b (hashes of role and text), chars and place."""
    rows = pick(turns, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null").fillna("", ["role", "text"])
    rows = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("m"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").cast("long").alias("chars"))
    hashed = stored(rows, "trie-hashed")
    found = placed(hashed.rows, ["conv_id"], ["turn", "role", "m"], "trie-turns")
    hashed.drop()
    return Stored(found.rows.select("conv_id", "a", "b", "chars", "place"), found.path)


def sizes(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, base, h, k (turns taken from base) and total (turns after rebuilding)."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    n = n.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads})
    bases = n.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    n = n.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    return n.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))


def _stretch(depth: Column | str, stretch: int) -> Column:
    return F.floor((F.col(depth) if isinstance(depth, str) else depth) / stretch).cast("long")


def prefixes(turns: DataFrame, convs: DataFrame, heads: int = HEADS, stretch: int = STRETCH) -> DataFrame:
    """A row per rebuilt turn: conv_id, depth, the keys of its prefix (k1, k2) and of the one before (p1, p2), chars, ends."""
    own = turns.join(convs, "conv_id").filter("place >= h").withColumn("depth", F.col("k") + F.col("place") - F.col("h") + 1)
    first = turns.filter(F.col("place") < heads - 1).select(F.col("conv_id").alias("base"), "a", "b", "chars", "place")
    taken = convs.join(first, "base").filter("place < k").withColumn("depth", F.col("place") + 1)
    columns = ["conv_id", "depth", "total", "a", "b", "chars"]
    rows = own.select(*columns).unionByName(taken.select(*columns))
    rows = rows.withColumns({"x1": F.xxhash64("depth", "a", "b"), "x2": F.xxhash64("b", "a", "depth"), "block": _stretch(F.col("depth") - 1, stretch)})
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = rows.filter(F.col("total") > stretch).groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    wb = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("conv_id", "block", F.bit_xor("x1").over(wb).alias("b1"), F.bit_xor("x2").over(wb).alias("b2"))
    rows = rows.withColumns({"s1": F.bit_xor("x1").over(w), "s2": F.bit_xor("x2").over(w)}).join(before, ["conv_id", "block"], "left")
    rows = rows.withColumns({f"k{i}": F.col(f"s{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0).cast("long"))) for i in (1, 2)})
    keys = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return rows.select("conv_id", "depth", "k1", "k2", *keys, "chars", (F.col("depth") == F.col("total")).alias("ends"))


def joined_hash(rows: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """k1, k2 and the SHA-256 of their conv_ids, ascending and joined by commas. Ranges join them to pieces; a hash takes its bytes
    one after the other, so the pieces of a key meet in one task, which streams them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        done: list[tuple] = []
        for b in batches:
            for a, c, i in zip(*[b.column(n).to_pylist() for n in ("k1", "k2", "conv_id")], strict=True):
                if (a, c) != key or size > piece_bytes:
                    if held:
                        done.append((*key, first, ",".join(held)))
                    key, first, held, size = (a, c), i, [], 0
                held.append(str(i))
                size += len(held[-1]) + 1
            if len(done) > 1000:
                yield _batch(done)
                done = []
        if held:
            done.append((*key, first, ",".join(held)))
        if done:
            yield _batch(done)

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["k1", "k2", "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        done: list[tuple] = []
        for b in batches:
            for a, c, piece in zip(*[b.column(n).to_pylist() for n in ("k1", "k2", "piece")], strict=True):
                if (a, c) != key:
                    if h:
                        done.append((*key, h.hexdigest()))
                    key, h = (a, c), sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
            yield _named(done)
            done = []
        if h:
            yield _named([(*key, h.hexdigest())])

    def _named(done: list[tuple]) -> pa.RecordBatch:
        a, c, h = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(h, pa.string())], ["k1", "k2", "ends_sha256"])

    keys = ["k1", "k2", "conv_id"]
    found = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pieces, "k1 long, k2 long, first long, piece string")
    return found.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashes, "k1 long, k2 long, ends_sha256 string")


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: its key, owner (smallest member), n_convs, chars of its last text, n_children, heavy (it is its parent's
    largest child, the one with the smaller owner of two) and the hash of the conversations that end there."""
    root = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*[zero.alias(k) for k in KEY], "owner", "n_convs", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"))
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("owner")).alias("o"), "k1", "k2")).alias("best"))
    largest = children.select(F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    ends = rows.filter("ends").select("k1", "k2", "conv_id").unionByName(convs.filter("total = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    found = nodes.unionByName(root.select(nodes.columns)).join(children.drop("best"), KEY, "left").join(largest, KEY, "left").join(joined_hash(ends), ["k1", "k2"], "left")
    return found.drop("p1", "p2").fillna(0, ["n_children"]).fillna(False, ["heavy"]).fillna(sha256(b"").hexdigest(), ["ends_sha256"])


def paths_of(rows: DataFrame, nodes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """nodes with the parent's owner, the head of their path (head, head_depth) and level, the number of light nodes from the root."""
    own = ["owner", "heavy", "n_convs", "chars", "n_children", "ends_sha256"]
    reps = rows.select("conv_id", *KEY).join(nodes.select(F.col("owner").alias("conv_id")).distinct(), "conv_id", "left_semi").join(nodes, KEY)
    kept = stored(reps.select("conv_id", "depth", *own).withColumn("block", _stretch(F.col("depth") - 1, stretch)), "trie-paths")
    rows, light = kept.rows, F.when(~F.col("heavy"), F.struct("depth", "owner"))
    w = Window.partitionBy("conv_id", "block").orderBy("depth")
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    per = rows.groupBy("conv_id", "block").agg(F.max_by("owner", "depth").alias("o"), F.max(light).alias("l"), F.count_if(~F.col("heavy")).alias("n"))
    wb = Window.partitionBy("conv_id").orderBy("block")
    above = wb.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv_id", "block", F.lag("o").over(wb).alias("o"), F.last("l", ignorenulls=True).over(above).alias("l"), F.sum("n").over(above).alias("n")).filter("block > 0")
    root = nodes.filter("depth = 0").select(F.col("owner").alias("root"))  # one row
    found = rows.withColumns({"up": F.lag("owner").over(w), "top": F.last(light, ignorenulls=True).over(here), "count": F.count_if(~F.col("heavy")).over(here)})
    found = found.filter("owner = conv_id").join(per, ["conv_id", "block"], "left").join(F.broadcast(root))
    top = F.coalesce("top", "l")
    found = found.select(
        "conv_id", "depth", F.coalesce("up", "o", "root").alias("parent_conv_id"), "n_convs", "n_children", "chars", "ends_sha256",
        F.coalesce(top["owner"], "root").alias("head"), F.coalesce(top["depth"], F.lit(0).cast("long")).alias("head_depth"), (F.col("count") + F.coalesce("n", F.lit(0))).cast("int").alias("level"),
    )
    top_row = nodes.filter("depth = 0").select(
        F.col("owner").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "chars", "ends_sha256", F.col("owner").alias("head"), F.col("depth").alias("head_depth"), F.lit(0).alias("level")
    )
    return found.unionByName(top_row)


def summed(paths: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Paths of one level with their values: n_leaves and saved_tokens summed from each path's lower end."""
    rows = paths.withColumn("block", _stretch(F.col("depth") - F.col("head_depth"), stretch))
    values = ["n_leaves", "saved_tokens"]
    down = Window.partitionBy("head", "head_depth", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("head", "head_depth").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = rows.groupBy("head", "head_depth", "block").agg(*[F.sum(v).alias(v) for v in values])
    after = after.select("head", "head_depth", "block", *[F.sum(v).over(below).alias(f"{v}_") for v in values]).filter("n_leaves_ is not null")
    rows = rows.withColumns({v: F.sum(v).over(down) for v in values}).join(after, ["head", "head_depth", "block"], "left")
    return rows.withColumns({v: F.col(v) + F.coalesce(f"{v}_", F.lit(0)) for v in values}).drop("block", *[f"{v}_" for v in values])


def build(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """A row per node; see FOUND."""
    order = ordered(turns)
    convs = stored(sizes(order.rows), "trie-sizes")
    rows = stored(prefixes(order.rows, convs.rows, stretch=stretch), "trie-prefixes")
    nodes = stored(nodes_of(rows.rows, convs.rows), "trie-nodes")
    paths = stored(paths_of(rows.rows, nodes.rows, stretch), "trie-levels", by=["level"])
    for done in (order, convs, rows, nodes):
        done.drop()
    levels = paths.rows.agg(F.max("level")).first()[0]
    rounds: list[DataFrame] = []
    for level in range(-1 if levels is None else levels, -1, -1):
        here = paths.rows.filter(F.col("level") == level)
        here = here.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
        if rounds:
            heads = rounds[-1].filter("depth = head_depth").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
            heads = heads.agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            here = here.join(heads, ["conv_id", "depth"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0))}).drop("l", "s")
        rounds.append(stored(summed(here, stretch), "trie-sums").rows)
    found = reduce(DataFrame.unionByName, rounds) if rounds else paths.rows.withColumns({"n_leaves": F.lit(0).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    return found.select(FOUND)


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql('conv_id')} % {HEADS} AS h, count(*) AS n FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT k.conv_id, k.k + t.place - k.h + 1 AS depth, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.place >= k.h
  UNION ALL SELECT k.conv_id, t.place + 1, role, text FROM k JOIN t ON t.conv_id = k.base AND t.place < k.k),
p AS (SELECT conv_id, depth, length(text) AS chars,
    string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id, depth, chars, sha256(node) AS node, lag(sha256(node)) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node),
ch AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (node)),
below AS (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
s AS (SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM below JOIN x USING (node) GROUP BY top)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.top = x.node LEFT JOIN n u ON u.node = x.parent
"""
