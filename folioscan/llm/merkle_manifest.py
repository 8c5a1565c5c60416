"""Merkle manifest of a table: leaf digests, a tree for each source, one root, and a proof for every row.

H is the lower-case hex SHA-256 of its inputs, concatenated. Leaves of a source follow doc_id; runs of 16 nodes become their H
until one node, the subroot, is left; subroots in the order of their sources likewise give the root.

Blocks of 4,096 nodes of a source are reduced by one task each. What is left is reduced again in the same way, and where the
sources are many their subroots too, until at most ``top`` nodes are left; the driver builds the tree above these and broadcasts
its levels (under 1.1 MB at the default), from which the executors take the upper part of every path. They then go down the
blocks again, finish the proofs and fold every row's leaf to a root.

Defined results: a null field is ``-``; null doc_ids and the null source come first; rows that repeat a doc_id follow the hex of
their leaves, and rows that are equal have equal leaves in neighbouring places; empty texts are texts; an empty table has no rows
and no root; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import Stored, crc32_sql, pick, placed, stored

ARITY = 16
DEPTH = 3
TOP = 1 << 14
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATHS = "tree string, place long, subroot string, root string, path array<struct<left:string,right:string>>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
SIBLINGS = ", siblings array<array<string>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _h(data: str) -> str:
    return sha256(data.encode()).hexdigest()


def levels_of(digests: list[str], arity: int = ARITY, steps: int | None = None) -> list[list[str]]:
    """The levels above and with these nodes: ``steps`` more, or as many as leave one node."""
    out = [digests]
    while len(out[-1]) > 1 if steps is None else len(out) <= steps:
        below = out[-1]
        out.append([_h("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return out


def path_of(levels: list[list[str]], at: int, arity: int = ARITY) -> list[tuple[str, str]]:
    """What stands left and right of the node in its run, level by level."""
    out = []
    for level in levels[:-1]:
        run, k = level[at - at % arity : at - at % arity + arity], at % arity
        out.append(("".join(run[:k]), "".join(run[k + 1 :])))
        at //= arity
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = _h(left + leaf + right)
    return leaf


def leaf_digest(text: Column | None = None) -> Column:
    """H of the fields, each ``-`` if null, else its bytes, ``:`` and itself; with another text in place of the row's, if given."""
    values = [(text if text is not None and name == "text" else F.col(name)).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def lower_fifth() -> Column:
    """The tampered text: A-Z lower-cased where 5 divides the crc32 of the decimal doc_id, else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit & F.rlike("text", F.lit("[A-Z]")), F.translate("text", UPPER, LOWER))


class Manifest(NamedTuple):
    """leaves: doc_id, leaf, forged (the leaf of the tampered row, if any), tree, place. rounds: the nodes (tree, place, digest)
    that blocks were reduced to; subroots that begin a tree of their own have their source as origin. top: the driver's levels."""

    leaves: Stored
    rounds: list[Stored]
    top: dict
    arity: int
    depth: int

    @property
    def root(self) -> str | None:
        return self.top["root"]


def _block(place: str, size: int) -> Column:
    return F.floor(F.col(place) / size).cast("long").alias("block")


def _in_order(t: pa.Table) -> pa.Table:
    return t.sort_by("place")


def _reduced(nodes: DataFrame, digest: str, arity: int, depth: int) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        block = key[1].as_py()
        top = levels_of(_in_order(t).column("digest").to_pylist(), arity, depth if block else None)[-1]  # a partial first block is alone
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "place": [block], "digest": top})

    rows = nodes.select("tree", "place", F.col(digest).alias("digest"), _block("place", arity**depth))
    return rows.groupBy("tree", "block").applyInArrow(run, "tree string, place long, digest string")


def build(docs: DataFrame, tampered: Callable[[], Column] | None = None, arity: int = ARITY, depth: int = DEPTH, top: int = TOP) -> Manifest:
    rows = pick(docs, **FIELDS)
    forged = tampered() if tampered else F.lit(None).cast("string")
    rows = rows.select("doc_id", F.col("source").alias("tree"), leaf_digest().alias("leaf"), F.when(forged.isNotNull(), leaf_digest(forged)).alias("forged"))
    hashed = stored(rows, "merkle-hashed")  # ranges are sampled first, and texts should be hashed once
    leaves = placed(hashed.rows, ["tree"], ["doc_id", "leaf"], "merkle-leaves")
    hashed.drop()
    above, rounds = False, [stored(_reduced(leaves.rows, "leaf", arity, depth), "merkle-nodes")]
    while rounds[-1].rows.limit(top + 1).count() > top:
        nodes = rounds[-1].rows
        if not above and nodes.filter("place > 0").isEmpty():  # a node for each source: they become the leaves of one tree
            above = True
            subroots = placed(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("origin"), "digest"), ["tree"], ["origin"], "merkle-subroots")
            rounds.pop().drop()
            rounds.append(subroots)
        rounds.append(stored(_reduced(rounds[-1].rows, "digest", arity, depth), "merkle-nodes"))
    return Manifest(leaves, rounds, _top(rounds[-1].rows.select("tree", "place", "digest").collect(), above, arity), arity, depth)


def _top(nodes: list, above: bool, arity: int) -> dict:
    """trees: the levels of each source and its number among them; over: the levels above the subroots."""
    by_tree: dict[str | None, list] = {}
    for tree, _, digest in sorted(nodes, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])):
        by_tree.setdefault(tree, []).append(digest)
    trees = {tree: levels_of(digests, arity) for tree, digests in by_tree.items()}
    over = [[]] if above else levels_of([levels[-1][0] for levels in trees.values()], arity)
    last = next(iter(trees.values()), [[]]) if above else over
    return {"trees": trees, "number": {t: i for i, t in enumerate(trees)}, "over": over, "root": last[-1][0] if last[-1] else None}


def _upper(top: dict, tree: str | None, place: int, arity: int) -> tuple[str, list[tuple[str, str]]]:
    """Subroot and path from one of the driver's nodes to the root."""
    levels = top["trees"][tree]
    path = path_of(levels, place, arity)
    return levels[-1][0], path + (path_of(top["over"], top["number"][tree], arity) if top["over"][0] else [])


def prove(manifest: Manifest, siblings: bool = False) -> DataFrame:
    """Per row doc_id, leaf, subroot, root, proof_sha256 (H of all siblings on the way up), folded_root (from the tampered leaf, where
    there is one, else from the row's own: every row's siblings are folded) and verified; with ``siblings`` the lists of them."""
    arity, depth = manifest.arity, manifest.depth
    size, root = arity**depth, manifest.root
    spark = manifest.leaves.rows.sparkSession
    held = spark.sparkContext.broadcast(manifest.top)

    def from_top(key: tuple) -> tuple[str, list[tuple[str, str]]]:
        return _upper(held.value, key[0].as_py(), key[1].as_py(), arity)

    def from_table(t: pa.Table) -> tuple[str, list[tuple[str, str]]]:
        row = t.select(["subroot", "path"]).to_pylist()[0]
        return row["subroot"], [(p["left"], p["right"]) for p in row["path"]]

    def down(key: tuple, t: pa.Table, subroot: str, upper: list) -> pa.Table:
        """Paths of the nodes of a block."""
        t = _in_order(t)
        digests, first = t.column("digest").to_pylist(), key[1].as_py() * size
        levels = levels_of(digests, arity, depth if key[1].as_py() else None)
        paths = [[{"left": a, "right": b} for a, b in path_of(levels, i, arity) + upper] for i in range(len(digests))]
        starts = "origin" in t.column_names  # these are subroots
        places = [0] * len(digests) if starts else list(range(first, first + len(digests)))
        return pa.table({
            "tree": t.column("origin").cast(pa.string()) if starts else t.column("tree").cast(pa.string()), "place": pa.array(places, pa.int64()), "subroot": digests if starts else [subroot] * len(digests),
            "root": [root] * len(digests), "path": pa.array(paths, PATH_TYPE),
        })

    def finish(key: tuple, t: pa.Table, subroot: str, upper: list) -> pa.Table:
        """Proofs and folds of the leaves of a block."""
        t = _in_order(t)
        leaves, forged = t.column("leaf").to_pylist(), t.column("forged").to_pylist()
        levels = levels_of(leaves, arity, depth if key[1].as_py() else None)
        end = "".join(a + b for a, b in upper)
        proofs, folded, lists = [], [], []
        shared: tuple[int, list, str] = (-1, [], "")
        for i, (leaf, other) in enumerate(zip(leaves, forged, strict=True)):
            if i // arity != shared[0]:  # all but the first step is shared by a run
                rest = path_of(levels[1:], i // arity, arity) + upper if len(levels) > 1 else upper
                shared = i // arity, rest, "".join(a + b for a, b in rest)
            own = path_of(levels[:2], i, arity) if len(levels) > 1 else []
            proofs.append(_h("".join(a + b for a, b in own) + (shared[2] if own else end)))
            folded.append(fold(leaf if other is None else other, own + shared[1]))
            if siblings:
                lists.append([[x[k : k + 64] for x in (a + b,) for k in range(0, len(x), 64)] for a, b in own + shared[1]])
        n = len(leaves)
        out = {"doc_id": t.column("doc_id"), "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded}
        return pa.table(out | ({"siblings": pa.array(lists, pa.list_(pa.list_(pa.string())))} if siblings else {}))

    def walk(rows: DataFrame, paths: DataFrame | None, step: Callable, schema: str) -> DataFrame:
        grouped = rows.withColumn("block", _block("place", size)).groupBy("tree", "block")
        if paths is None:
            return grouped.applyInArrow(lambda key, t: step(key, t, *from_top(key)), schema)
        return grouped.cogroup(paths.groupBy("tree", "place")).applyInArrow(lambda key, t, p: step(key, t, *from_table(p)), schema)

    paths = None
    for below in reversed(manifest.rounds[:-1]):
        paths = walk(below.rows, paths, down, PATHS)
    found = walk(manifest.leaves.rows, paths, finish, PROOFS + (SIBLINGS if siblings else ""))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 6, over: int = 4) -> str:
    """DuckDB SQL for tables of up to 16**levels rows a source and 16**over sources."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    crc = crc32_sql("doc_id")
    ctes = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS forged FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "l0 AS (SELECT source, pos, leaf AS digest FROM n0)",
        "p0 AS (SELECT doc_id, source, leaf, row_number() OVER () AS row, pos, coalesce(forged, leaf) AS cur, '' AS proof FROM n0)",
    ]

    def step(nodes: str, up: str, rows: str, out: str, key: str, same: str, keep: str) -> None:
        """One level: a tree of a single node stays as it is."""
        ctes.append(f"{nodes}c AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {nodes})")
        ctes.append(f"{up} AS (SELECT {key}, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {nodes}c GROUP BY {key}, pos // 16)")
        ctes.append(f"""{out} AS (
  SELECT {keep}, any_value(r.pos) // 16 AS pos, CASE WHEN any_value(c.n) = 1 THEN any_value(r.cur) ELSE sha256(
    coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (c.pos < r.pos), '') || any_value(r.cur) || coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (c.pos > r.pos), '')) END AS cur,
    any_value(r.proof) || coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (c.pos <> r.pos), '') AS proof
  FROM {rows} r JOIN {nodes}c c ON {same} AND c.pos // 16 = r.pos // 16 GROUP BY {keep})""")

    for i in range(levels):
        step(f"l{i}", f"l{i + 1}", f"p{i}", f"p{i + 1}", "source", "c.source IS NOT DISTINCT FROM r.source", "r.row, r.doc_id, r.source, r.leaf")
    ctes.append(f"s0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, source, digest FROM l{levels})")
    ctes.append(f"q0 AS (SELECT p.doc_id, p.leaf, s.digest AS subroot, p.row, s.pos, p.cur, p.proof FROM p{levels} p JOIN s0 s ON s.source IS NOT DISTINCT FROM p.source)")
    for i in range(over):
        step(f"s{i}", f"s{i + 1}", f"q{i}", f"q{i + 1}", "one", "c.one = 0", "r.row, r.doc_id, r.leaf, r.subroot")
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, s.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = s.digest AS verified FROM q{over}, s{over} s"
    )


ORACLE_SQL = oracle_sql()
