"""Text of chapters for later processing: combined, cut at lines, split at paragraphs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attach_descriptions(images: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Images (with url) get their description from a table; those without one are dropped."""
    return images.join(descriptions.select("url", "description"), "url")


def combine_content(title: Column, level: Column, parent_path: Column, content: Column, images: Column | None = None) -> Column:
    """Heading lines, the text and a numbered list of images (struct position, alt_text, title, context, description)."""
    path = F.when(F.coalesce(parent_path, F.lit("")) != "", F.concat(F.lit("路径: "), parent_path, F.lit(" > "), title))
    text = F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit("## 文本内容\n"), content, F.lit("\n")))
    lines = [F.concat(F.lit("# 章节: "), title), F.concat(F.lit("层级: H"), level.cast("string")), path, F.lit(""), text]
    if images is not None:
        said = (("alt_text", "Alt文本"), ("title", "标题"), ("context", "上下文"), ("description", "图像描述"))

        def entry(x, i):
            more = [F.when(F.coalesce(x[f], F.lit("")) != "", F.concat(F.lit(f"**{name}**: "), x[f])) for f, name in said]
            return F.concat_ws("\n", F.concat(F.lit("### 图片 "), (i + 1).cast("string")), F.concat(F.lit("**位置**: "), x["position"]), *more, F.lit(""))

        lines.append(F.when(F.size(images) > 0, F.concat(F.lit("## 图像内容\n"), F.array_join(F.transform(images, entry), "\n"))))
    return F.concat_ws("\n", *lines)


def truncate_at_lines(text: Column, most: int | Column) -> Column:
    """Whole lines while they fit, counting a line end each, then a notice with both lengths."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"), F.lit(True).alias("open"))

    def add(acc, line):
        fits = acc["open"] & (acc["n"] + F.length(line) + 1 <= most)
        return F.struct(F.when(fits, acc["n"] + F.length(line) + 1).otherwise(acc["n"]).alias("n"), (acc["lines"] + fits.cast("int")).alias("lines"), fits.alias("open"))

    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.slice(lines, F.lit(1), F.aggregate(lines, zero, add, lambda acc: acc["lines"])), "\n")
    notice = F.concat(F.lit("\n\n[注意: 内容因长度限制被截断，原长度: "), F.length(text), F.lit(" 字符，截断后: "), F.length(kept), F.lit(" 字符]"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(kept, notice))


def cut(text: str, most: int, separator: str) -> list[str]:
    """Parts of a text: paragraphs while their lengths add up to at most ``most``, one at least. Sums of lengths are searched for the
    last paragraph of each part, and a part is a stretch of the text, so nothing is built up piece by piece."""
    parts = text.split(separator)
    sums = list(accumulate(map(len, parts), initial=0))
    out, at, k = [], 0, 0
    while k < len(parts):
        stop = max(k + 1, bisect_right(sums, sums[k] + most, k + 1) - 1)
        size = sums[stop] - sums[k] + (stop - k - 1) * len(separator)
        out.append(text[at : at + size])
        at, k = at + size + len(separator), stop
    return out


def split_chapters(chapters: DataFrame, most: int | Column, separator: str = "\n\n") -> DataFrame:
    """A row per part: paragraphs fill a part up to most characters (separators not counted); an oversized one stays whole.

    Chapters that fit are part 0 under their own title; a null content is one of them. A column images stays with the first part;
    other parts have none."""
    images = ["images"] if "images" in chapters.columns else []
    limit = F.lit(most) if isinstance(most, int) else most
    rows = chapters.select("doc_id", "seq", "title", "content", limit.cast("long").alias("_most"), *images)
    schema = T.StructType([*[f for f in rows.schema if f.name in ("doc_id", "seq", "title", "images")], T.StructField("large", T.BooleanType()), T.StructField("i", T.IntegerType()), T.StructField("text", T.StringType())])
    kept = [f.name for f in schema][: -3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_of, large, place, texts = [], [], [], []
            for r, (text, limit) in enumerate(zip(b.column("content").to_pylist(), b.column("_most").to_pylist(), strict=True)):
                big = text is not None and len(text) > limit
                for i, part in enumerate(cut(text, limit, separator) if big else [text]):
                    rows_of.append(r), large.append(big), place.append(i), texts.append(part)
            at = pa.array(rows_of, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in kept], pa.array(large, pa.bool_()), pa.array(place, pa.int32()), pa.array(texts, pa.string())], [f.name for f in schema])

    rows = rows.mapInArrow(run, schema)
    part = F.when(F.col("large"), F.col("i") + 1).otherwise(0)
    title = F.when(F.col("large"), F.concat("title", F.lit(" (第"), part.cast("string"), F.lit("部分)"))).otherwise(F.col("title"))
    own = [F.when(F.col("i") == 0, F.col("images")).otherwise(F.array().cast(rows.schema["images"].dataType)).alias("images") for _ in images]
    return rows.select("doc_id", "seq", part.alias("part"), title.alias("title"), "text", *own)


def chunk_mode(chapters: DataFrame, limit: int = 64_000, plain: int = 32_000) -> DataFrame:
    """Per document: whether its content needs chunks, and the length that then holds for a chapter."""
    total = F.sum(F.length("content"))
    return chapters.groupBy("doc_id").agg(total.alias("total_length"), (total > limit).alias("chunked"), F.when(total > limit, limit).otherwise(plain).alias("most"))


def integrate(chapters: DataFrame, limit: int = 64_000, plain: int = 32_000) -> DataFrame:
    """doc_id, seq, part, title, text: combined texts, cut at lines to ``plain`` characters; in documents with more than ``limit``
    characters of content, to ``limit``, and what is still longer (by the notice) is split at paragraphs.

    chapters: doc_id, seq, title, level, content, parent_path."""
    mode = chunk_mode(chapters, limit, plain)
    text = combine_content(F.col("title"), F.col("level"), F.col("parent_path"), F.col("content"))
    rows = chapters.select("doc_id", "seq", "title", text.alias("content")).join(mode, "doc_id").withColumn("content", truncate_at_lines(F.col("content"), F.col("most")))
    return split_chapters(rows.filter("chunked"), limit).unionByName(rows.filter("not chunked").select("doc_id", "seq", F.lit(0).alias("part"), "title", F.col("content").alias("text")))
