"""Outlines of documents: one walk over chapters in order gives parents, ancestors and ranges of descendants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 6
#: Fixed value.
NO_TITLE = "未知文档"
_ANCESTORS = pa.list_(pa.struct([("seq", pa.int32()), ("title", pa.string()), ("level", pa.int32())]))
OUTLINE = "doc_id long, seq int, title string, level int, parent_seq int, parent_level int, ancestors array<struct<seq:int,title:string,level:int>>, pre int, end int"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("seq", pa.int32()), ("title", pa.string()), ("level", pa.int32()), ("parent_seq", pa.int32()), ("parent_level", pa.int32()), ("ancestors", _ANCESTORS), ("pre", pa.int32()), ("end", pa.int32()),
])


class Stack:
    """The open chapters of one document, outer to inner. A chapter closes those of its own or a larger level."""

    def __init__(self) -> None:
        self.open: list[tuple] = []  # (row, ancestors)
        self.pre = 0

    def add(self, seq: int, title: str | None, level: int | None) -> list[tuple]:
        """The rows (seq to end) of the chapters that this one closes. A null level closes all and has no parent."""
        closed = []
        while self.open and (level is None or self.open[-1][0][2] is not None and self.open[-1][0][2] >= level):
            closed.append(self._close())
        above = [*self.open[-1][1], self.open[-1][0][:3]] if self.open else []
        parent = above[-1] if above else (None, None, None)
        self.open.append(((seq, title, level, parent[0], parent[2]), above, self.pre))
        self.pre += 1
        return closed

    def rest(self) -> list[tuple]:
        return [self._close() for _ in range(len(self.open))]

    def _close(self) -> tuple:
        row, above, pre = self.open.pop()
        return (*row, [{"seq": s, "title": t, "level": k} for s, t, k in above], pre, self.pre - 1)


def build_outline(chapters: DataFrame) -> DataFrame:
    """doc_id, seq, title and level of each chapter with parent_seq and parent_level (null at the top), ancestors (outer to inner),
    path, depth, pre (its place from 0) and end (the place of its last descendant, its own if it has none).

    The parent is the nearest preceding chapter of smaller level, whatever the levels are; a chapter without level stands at the top
    and is a parent of whatever follows. Documents go in order through sorted partitions; of one only the open chapters are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, stack = None, None
        for b in batches:
            rows: list[tuple] = []
            for at, seq, title, level in zip(*[b.column(c).to_pylist() for c in ("doc_id", "seq", "title", "level")], strict=True):
                if stack is None or at != doc:
                    rows += [(doc, *r) for r in stack.rest()] if stack else []
                    doc, stack = at, Stack()
                rows += [(doc, *r) for r in stack.add(seq, title, level)]
            if rows:
                yield _batch(rows)
        if stack:
            yield _batch([(doc, *r) for r in stack.rest()])

    narrow = chapters.select(F.col("doc_id").cast("long"), F.col("seq").cast("int"), F.col("title").cast("string"), F.col("level").cast("int"))
    rows = narrow.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, OUTLINE)
    return rows.select("*", F.array_join(F.transform("ancestors", lambda x: x["title"]), " > ", "").alias("path"), F.size("ancestors").alias("depth"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def level_issues(outline: DataFrame) -> DataFrame:
    """Chapters more than one level below their parent. Siblings cannot jump in an outline that is built by levels."""
    full = F.when(F.col("path") == "", F.col("title")).otherwise(F.concat_ws(" > ", "path", "title"))
    text = F.concat(F.lit("章节层级跳跃: "), full, F.lit(" (从 H"), F.col("parent_level"), F.lit(" 跳到 H"), F.col("level"), F.lit(")"))
    return outline.filter(F.col("level") > F.col("parent_level") + 1).select("doc_id", "seq", text.alias("issue"))


def outline_summary(outline: DataFrame) -> DataFrame:
    """Per chapter: depth and number of children."""
    children = outline.filter("parent_seq is not null").groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count("*").alias("n_children"))
    return outline.select("doc_id", "seq", "level", "depth").join(children, ["doc_id", "seq"], "left").fillna(0, ["n_children"])


def outline_profile(outline: DataFrame) -> DataFrame:
    """Per document: total, max_level, max_depth, and the number of chapters of each level that occurs, as a map."""
    per = outline.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
    levels = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "n")))))
    return per.groupBy("doc_id").agg(F.sum("n").alias("total"), F.max("level").alias("max_level"), F.max("d").alias("max_depth"), levels.alias("levels"))


def breadcrumbs(chapters: DataFrame) -> DataFrame:
    """doc_id, seq, breadcrumb: the titles above a chapter, outer to inner."""
    return build_outline(chapters).select("doc_id", "seq", F.col("path").alias("breadcrumb"))


def document_summary(chapters: DataFrame, documents: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Per document: chapters, content length, largest level, average length, chapters per level; with images (doc_id and a row
    per image) their number, with documents (doc_id, title, url) also these, for documents without chapters too."""
    levels = [F.count_if(F.col("level") == k).alias(f"h{k}") for k in range(1, LEVELS + 1)]
    found = chapters.groupBy("doc_id").agg(
        F.count("*").alias("n_chapters"), F.sum(F.length("content")).alias("content_length"), F.max("level").alias("max_level"), F.floor(F.sum(F.length("content")) / F.count("*")).alias("avg_length"), *levels
    )
    if documents is not None:
        found = documents.select("doc_id", F.coalesce("title", F.lit(NO_TITLE)).alias("title"), "url").join(found, "doc_id", "left").fillna(0, [c for c in found.columns if c != "doc_id"])
    if images is not None:
        found = found.join(images.groupBy("doc_id").agg(F.count("*").alias("n_images")), "doc_id", "left").fillna(0, ["n_images"])
    return found
