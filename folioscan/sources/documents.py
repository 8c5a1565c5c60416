"""Readers, writers and the adapters that turn tables of documents into chapters, pairs and pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels that the adapter gives to a document's lines, over and over from a place that its id chooses; 2 to 4 is a jump.
LEVELS = (1, 2, 3, 2, 4, 1, 3)


#: What stands for null in CSV, so that an empty text comes back as one.
NULL = "\\N"
#: Why a record is not a page.
BROKEN, NO_URL, NO_HTML = "broken record", "no address", "no page"


def read_checked(spark: SparkSession, path: str, fmt: str = "parquet", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """url, html, file, record and reason of every record of Parquet, JSON (a record a line), CSV (with a header; quoted fields may
    hold quotes, doubled, and line ends) or text (a file a page). Columns are read as given, nothing is inferred. reason is null for
    pages; a record that does not parse keeps its raw form in record."""
    if fmt == "text":
        rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"), F.lit(None).cast("string").alias("record"))
    elif fmt in ("csv", "json"):
        own = {"multiLine": True, "header": True, "enforceSchema": False, "quote": '"', "escape": '"', "nullValue": NULL} if fmt == "csv" else {"encoding": "UTF-8"}
        rows = spark.read.format(fmt).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_record", **own)
        names = spark.read.options(**own).csv(path).columns if fmt == "csv" else [url_column, html_column]
        rows = rows.schema(", ".join([*[f"`{n}` string" for n in names], "_record string"])).load(path)
        rows = rows.select(F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html"), F.col("_record").alias("record"))
    else:
        rows = spark.read.format(fmt).load(path).select(F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"), F.lit(None).cast("string").alias("record"))
    reason = F.when(F.col("record").isNotNull(), BROKEN).when(F.coalesce("url", F.lit("")) == "", NO_URL).when(F.col("html").isNull(), NO_HTML)
    return rows.select("url", "html", F.input_file_name().alias("file"), "record", reason.alias("reason"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Pages (url, html); other records are in rejected()."""
    return read_checked(spark, path, fmt, url_column, html_column).filter("reason is null").select("url", "html")


def rejected(records: DataFrame) -> DataFrame:
    """file, url, record and reason of the records of read_checked() that are no pages."""
    return records.filter("reason is not null").select("file", "url", "record", "reason")


def load_counts(records: DataFrame) -> DataFrame:
    """Per file: pages, and rejected records by reason."""
    by = {"n_pages": F.col("reason").isNull(), "n_broken": F.col("reason") == BROKEN, "n_without_url": F.col("reason") == NO_URL, "n_without_html": F.col("reason") == NO_HTML}
    return records.groupBy("file").agg(*[F.count_if(c).alias(n) for n, c in by.items()])


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    own = {"header": True, "quote": '"', "escape": '"', "nullValue": NULL} if fmt == "csv" else {}
    df.write.partitionBy(*(partition_by or [])).format(fmt).options(**own).save(path)


def work_path(spark: SparkSession, what: str) -> str:
    """A new path for a table that a job keeps for itself, in the folder that driver and executors share; a local session without one
    gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def filter_min_length(pages: DataFrame, least: int = 100) -> DataFrame:
    return pages.filter(F.length("html") >= least)


def validate_documents(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """valid: url and text are there and at least one chapter; empty titles and levels out of 1..6 are counted only."""
    counts = chapters.groupBy("doc_id").agg(
        F.count("*").alias("n_chapters"), F.count_if(F.trim("title") == "").alias("n_empty_titles"), F.count_if(~F.col("level").between(1, 6)).alias("n_bad_levels")
    )
    joined = documents.select("doc_id", "url", "html").join(counts, "doc_id", "left").fillna(0, ["n_chapters", "n_empty_titles", "n_bad_levels"])
    ok = F.col("url").isNotNull() & (F.col("url") != "") & F.col("html").isNotNull() & (F.col("n_chapters") > 0)
    return joined.select("doc_id", ok.alias("valid"), "n_chapters", "n_empty_titles", "n_bad_levels")


def chapters_from_documents(documents: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """A chapter per line: doc_id, source, seq, title (a number and the line's first four words), level, content, position."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("seq", "content"))
    level = F.element_at(F.array(*map(F.lit, levels)), ((F.col("seq") + F.col("doc_id")) % len(levels) + 1).cast("int"))
    number = (F.col("seq") + 1 + F.col("doc_id") % 3).cast("string")
    title = F.concat(number, F.lit(". "), F.substring_index("content", " ", 4))
    return lines.select("doc_id", "source", "seq", title.alias("title"), level.alias("level"), "content", F.col("seq").alias("position"))


def check_pairs(documents: DataFrame) -> DataFrame:
    """pair_id (the target's id), template_doc_id (the smallest of the target's source), target_doc_id."""
    templates = documents.groupBy("source").agg(F.min("doc_id").alias("template_doc_id"))
    joined = documents.select("doc_id", "source").join(templates, "source").filter(F.col("doc_id") > F.col("template_doc_id"))
    return joined.select(F.col("doc_id").alias("pair_id"), "template_doc_id", F.col("doc_id").alias("target_doc_id"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_from_chapters(chapters: DataFrame) -> DataFrame:
    """A page per document: a first h1, then a heading and a paragraph for each chapter, an image on every fifth."""
    head = F.concat(F.lit("<h"), F.col("level"), F.lit(' id="c'), F.col("seq"), F.lit('">'), escape(F.col("title")), F.lit("</h"), F.col("level"), F.lit(">"))
    image = F.when(F.col("seq") % 5 == 0, F.concat(F.lit('<p><img src="/i/'), F.col("seq"), F.lit('.png" alt="picture"></p>'))).otherwise(F.lit(""))
    part = F.concat(head, F.lit("<p>"), escape(F.col("content")), F.lit("</p>"), image)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", part.alias("part")))), lambda x: x["part"]), "\n")
    pages = chapters.groupBy("doc_id").agg(body.alias("body"))
    return pages.select("doc_id", F.concat(F.lit("<html><head><title>Doc "), F.col("doc_id"), F.lit("</title></head><body><h1>Doc</h1>\n"), F.col("body"), F.lit("</body></html>")).alias("html"))
