"""Outline comparison without scores: both trees of a pair are descended together, once.

A document's outline is one row of arrays in pre-order, in which a chapter's descendants are a range; a pair's two outlines meet in
one row and one task goes down both. Templates, which are few and serve many pairs, are salted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.titles import clean_title
from folioscan.operators.similarity import with_template

REACHED = "pair_id long, seq int, match int, pre int, end int"
_MANY = 256


def outline_rows(outline: DataFrame) -> DataFrame:
    """doc_id and nodes: seq, end and cleaned title of every chapter, in pre-order."""
    node = F.struct("pre", "end", "seq", clean_title(F.coalesce("title", F.lit(""))).alias("clean"))
    return outline.groupBy("doc_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def children(end: list[int], at: int) -> list[int]:
    """Places of the children of the chapter at this place; of the top ones for -1."""
    out, k, last = [], at + 1, end[at] if at >= 0 else len(end) - 1
    while k <= last:
        out.append(k)
        k = end[k] + 1
    return out


def first_similar(left: list[str], right: list[str]) -> list[int | None]:
    """For each left title the first right one that is equal, contains it or is contained in it.

    Large families go through two automata: one finds the right titles inside each left one, one the left titles inside each right."""
    if len(left) * len(right) <= _MANY:
        return [next((j for j, r in enumerate(right) if l in r or r in l), None) for l in left]  # noqa: E741
    import ahocorasick

    found: list[int | None] = [None] * len(left)
    empty = next((j for j, r in enumerate(right) if r == ""), None)  # an empty title is part of every other
    inside = ahocorasick.Automaton()
    for j in range(len(right) - 1, -1, -1):  # the first of equal titles stays
        if right[j]:
            inside.add_word(right[j], j)
    inside.make_automaton()
    around, same = ahocorasick.Automaton(), {}
    for i, title in enumerate(left):
        best = [j for _, j in inside.iter(title)] if title and len(inside) else []
        found[i] = min([*best, *([] if empty is None else [empty])], default=None) if title else (0 if right else None)
        if title:
            same.setdefault(title, []).append(i)
            around.add_word(title, title)
    if len(around):
        around.make_automaton()
        open_titles = len(same)
        for j, title in enumerate(right):
            if not open_titles:
                break
            for word in {w for _, w in around.iter(title)}:
                for i in same.pop(word, ()):
                    found[i] = j if found[i] is None else min(found[i], j)
            open_titles = len(same)
    return found


def descend(left: list[dict], right: list[dict]) -> list[tuple]:
    """(seq, seq of the match or None, place, end) of every left chapter that is reached. Each child of a matched chapter takes the
    first similar child of the one it was matched with; several may take the same."""
    l_end, r_end, out = [n["end"] for n in left], [n["end"] for n in right], []
    todo = [(-1, -1)]
    while todo:
        a, b = todo.pop()
        ours, theirs = children(l_end, a), children(r_end, b)
        for k, m in zip(ours, first_similar([left[k]["clean"] for k in ours], [right[k]["clean"] for k in theirs]), strict=True):
            out.append((left[k]["seq"], None if m is None else right[theirs[m]]["seq"], k, l_end[k]))
            if m is not None and l_end[k] > k:
                todo.append((k, theirs[m]))
    return out


def tree_descent(pairs: DataFrame, outline: DataFrame, left: str, right: str) -> DataFrame:
    """Chapters of the left outline that the descent reaches: pair_id, seq, match (the right one's seq, or null), and the places of
    the chapter and of its last descendant. A pair whose left document has no chapters gives none."""
    known = outline_rows(outline)
    both = pairs.select("pair_id", "template_doc_id", "target_doc_id")
    rows = with_template(both, known.withColumnRenamed("nodes", "template_nodes"), keep=True)
    rows = rows.join(known.select(F.col("doc_id").alias("target_doc_id"), F.col("nodes").alias("target_nodes")), "target_doc_id", "left")
    name = {"template_doc_id": "template_nodes", "target_doc_id": "target_nodes"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, pair in enumerate(b.column("pair_id").to_pylist()):
                out += [(pair, *r) for r in descend(b.column("l")[i].as_py() or [], b.column("r")[i].as_py() or [])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.int32()] * 4), strict=True)], ["pair_id", "seq", "match", "pre", "end"])

    return rows.select("pair_id", F.col(name[left]).alias("l"), F.col(name[right]).alias("r")).mapInArrow(run, REACHED)


def tree_missing(pairs: DataFrame, outline: DataFrame) -> DataFrame:
    """Template chapters that the descent reaches and does not find; what lies below them is not reported."""
    return tree_descent(pairs, outline, "template_doc_id", "target_doc_id").filter("match is null").select("pair_id", "seq")


def tree_extra(pairs: DataFrame, outline: DataFrame) -> DataFrame:
    """Target chapters that the descent does not find in the template, with all their descendants, which are a range of places.

    Of chapters with the same title the document's first one is named."""
    lost = tree_descent(pairs, outline, "target_doc_id", "template_doc_id").filter("match is null")
    rows = lost.select("pair_id", F.explode(F.sequence("pre", "end")).alias("pre")).join(pairs.select("pair_id", F.col("target_doc_id").alias("doc_id")), "pair_id")
    first = outline.select("doc_id", "pre", F.min("seq").over(Window.partitionBy("doc_id", "title")).alias("first_seq"))
    return rows.join(first, ["doc_id", "pre"]).select("pair_id", F.col("first_seq").alias("seq"))


def tree_similarity(pairs: DataFrame, outline: DataFrame) -> DataFrame:
    """Matched template nodes by template nodes; 1 for an empty template."""
    hits = tree_descent(pairs, outline, "template_doc_id", "target_doc_id").groupBy("pair_id").agg(F.count("match").alias("n_matched"))
    total = outline.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = with_template(pairs.select("pair_id", "template_doc_id"), total, keep=True).join(hits, "pair_id", "left")
    return rows.select("pair_id", F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("n_matched", F.lit(0)) / F.col("n")).alias("similarity"))
