"""Blocks to chapters: h1 sections and the sections below them, by windows inside a parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.urls import absolute_url

AT = ["doc_id", "parent_id"]
BODY = ("p", "div", "section", "article", "ul", "ol", "table", "pre", "blockquote")


def _placed(blocks: DataFrame, skip_first: bool) -> DataFrame:
    """Blocks with the nearest h1 before them under the same parent (top: position, idx, ord, title, html_id), and without the others."""
    is_h1 = F.col("tag") == "h1"
    number = F.sum(is_h1.cast("int")).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - (2 if skip_first else 1)
    head = F.when(is_h1, F.struct(F.col("_number").cast("int").alias("position"), "idx", "ord", F.col("text").alias("title"), "html_id"))
    top = F.last(head, ignorenulls=True).over(Window.partitionBy(*AT).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_number", number).withColumn("top", top).filter("top is not null").drop("_number")


def h1_sections(blocks: DataFrame, skip_first: bool = True) -> DataFrame:
    """doc_id, position, title, level, content, html_id: an h1 with the texts beside it up to the next one; empty ones go."""
    rows = _placed(blocks, skip_first).filter("tag <> 'h1' and text <> '' and top.position >= 0 and top.title <> ''")
    rows = rows.groupBy("doc_id", "top.position", "top.title", "top.html_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("x"))
    return rows.select("doc_id", "position", "title", F.lit(1).alias("level"), F.array_join(F.transform("x", lambda t: t["text"]), "\n").alias("content"), "html_id")


def sub_sections(blocks: DataFrame, skip_first: bool = True) -> DataFrame:
    """The h2 to h6 beside each section's h1, which is the first h1 of the page with that title, with parent_path and content.

    Content: body elements of over five characters up to a heading of its own or a smaller level, or to another element whose
    name starts with h. Windows find which sections are open at each element, so blocks are read once and nothing is joined."""
    rows = _placed(blocks, skip_first).withColumn("top_idx", F.col("top.idx")).withColumn("top_title", F.col("top.title"))
    of_top, of_title = Window.partitionBy(*AT, "top_idx"), Window.partitionBy("doc_id", "top_title")
    full = F.max((F.col("tag") != "h1") & (F.col("text") != "")).over(of_top) & (F.col("top.position") >= 0) & (F.col("top_title") != "")
    rows = rows.withColumn("full", full)
    rows = rows.withColumns({"owners": F.sort_array(F.collect_set(F.when(F.col("full"), F.col("top.position"))).over(of_title)), "first": F.min("top.ord").over(of_title)}).filter(F.col("top.ord") == F.col("first"))
    level = F.when(F.col("tag").isin("h2", "h3", "h4", "h5", "h6"), F.substring("tag", 2, 1).cast("int"))
    rank = F.when(F.startswith("tag", F.lit("h")), F.coalesce(F.try_to_number(F.substring("tag", 2, 1), F.lit("9")).cast("int"), F.lit(0)))
    rows = rows.withColumns({"level": level, "rank": rank})
    before = of_top.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(before)
    named = F.col("text") != ""
    heads = [last((F.col("level") == k) & named, F.struct("idx", F.col("text").alias("title"), "level")) for k in range(2, 6)]
    opened = [(last(F.col("level") == k, F.col("idx")), last(F.col("rank") <= k, F.col("idx"))) for k in range(2, 7)]
    rows = rows.withColumns({
        "i": F.count("level").over(before), **{f"_h{k}": h for k, h in enumerate(heads, 2)}, **{f"_o{k}": o for k, (o, _) in enumerate(opened, 2)}, **{f"_s{k}": s for k, (_, s) in enumerate(opened, 2)},
    })
    chain = F.array_compact(F.array(*[F.when(F.col("level") > k, F.col(f"_h{k}")) for k in range(2, 6)]))
    # walking back, each step takes the nearest earlier section of a smaller level than the one taken before
    near = F.filter("_l", lambda x: ~F.exists("_l", lambda y: (y["level"] < x["level"]) & (y["idx"] > x["idx"])))
    rows = rows.withColumn("_l", chain).withColumn("_t", F.transform(F.sort_array(near, asc=False), lambda x: x["title"]))
    is_body = F.col("tag").isin(*BODY) & (F.length("text") > 5)
    inside = F.array_compact(F.array(*[F.when(F.col(f"_o{k}") == F.col(f"_s{k}"), F.col(f"_o{k}")) for k in range(2, 7)]))
    keys = F.when(F.col("level").isNotNull() & named, F.array("idx")).when(is_body, inside)
    head = F.when(F.col("level").isNotNull(), F.struct("i", F.col("text").alias("title"), "level", "html_id", F.col("_t").alias("up"), F.col("top_title").alias("owner_title"), "owners"))
    rows = rows.select(*AT, F.explode(keys).alias("at"), head.alias("head"), F.when(is_body, F.struct("idx", "text")).alias("body"))
    rows = rows.groupBy(*AT, F.col("at").alias("idx")).agg(F.max("head").alias("head"), F.sort_array(F.collect_list("body")).alias("x")).filter("head is not null")
    path = F.concat_ws(" > ", F.array("head.owner_title"), F.col("head.up"))
    return rows.select(*AT, "idx", F.explode("head.owners").alias("owner"), "head", path.alias("parent_path"), F.array_join(F.transform("x", lambda t: t["text"]), "\n\n").alias("content")).select(
        *AT, "idx", "owner", (F.col("owner") * 100 + F.col("head.i")).cast("int").alias("position"), "head.title", "head.level", "head.html_id", "parent_path", "content"
    )


def chapter_images(chapters: DataFrame, pages: DataFrame, origin=None) -> DataFrame:
    """doc_id, seq, number, url, alt_text, image_title, context, position: the images in the region of a chapter's id, or else of its
    title. Chapters that share a container get all its images each. Numbers count images without source, which are left out.

    pages: doc_id, images and regions of html.parsed(), one row a page, so a page is parsed once and its images are never joined."""
    rows = chapters.select("doc_id", "seq", "title", "html_id").join(pages.select("doc_id", "images", "regions"), "doc_id")
    first = lambda cond: F.try_element_at(F.filter("regions", cond), F.lit(1))
    at = F.coalesce(first(lambda r: r["html_id"] == F.col("html_id")), first(lambda r: r["heading"] == F.col("title")))
    rows = rows.withColumn("at", at).filter("at is not null")
    inside = F.filter("images", lambda i: i["ord"].between(F.col("at.first"), F.col("at.last")))
    rows = rows.select("doc_id", "seq", F.col("title").alias("chapter"), F.posexplode(inside).alias("n", "i")).filter("i.src <> ''")
    url = F.col("i.src") if origin is None else absolute_url(F.col("i.src"), origin)
    number = F.col("n") + 1
    return rows.select("doc_id", "seq", number.alias("number"), url.alias("url"), "i.alt_text", F.col("i.title").alias("image_title"), "i.context", F.concat("chapter", F.lit(" - 图片"), number.cast("string")).alias("position"))


def page_chapters(blocks: DataFrame, skip_first: bool = True) -> DataFrame:
    """doc_id, seq, title, level, content, position, html_id, parent_path: each h1 section followed by its sub-sections."""
    tops = h1_sections(blocks, skip_first)
    subs = sub_sections(blocks, skip_first)
    a = tops.select("doc_id", F.col("position").alias("owner"), F.lit(-1).alias("idx"), "title", "level", "content", "position", "html_id", F.lit("").alias("parent_path"))
    rows = a.unionByName(subs.select(*a.columns))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("owner", "idx")) - 1
    return rows.select("doc_id", seq.alias("seq"), "title", "level", "content", "position", "html_id", "parent_path")
