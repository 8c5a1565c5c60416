"""The figures of a report, one row per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.outline import document_summary
from folioscan.operators.rules import N_RULES
from folioscan.operators.similarity import with_template


def percent(share: Column) -> Column:
    """In hundredths with one decimal, halves away from zero. Spark's round goes by the decimal form of a double: 0.5695 * 100 is
    56.949999999999996 and would be 56.9, so the tenths are rounded as whole numbers."""
    return F.round(share * 100 * 10) / 10


def report(pairs: DataFrame, structure: DataFrame | None, content: DataFrame | None, outline: DataFrame, rules_checked: int = N_RULES) -> DataFrame:
    """Figures of both checks and overall ones; a check that is off (None) counts nothing, passes and has similarity 100.

    ``rules_checked``: how many rules were held against each chapter. A pair without a structure row was not compared: it fails the
    check with similarity 0; a target without a content row has no chapters and passes."""
    per_doc = outline.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("parent_seq").isNull()).alias("top"))
    rows = with_template(pairs, per_doc.select("doc_id", F.col("n").alias("template_chapters"), F.col("top").alias("n_top")), keep=True)
    rows = rows.join(per_doc.select(F.col("doc_id").alias("target_doc_id"), F.col("n").alias("total_chapters")), "target_doc_id", "left")
    if structure is not None:
        own = structure.select("pair_id", "n_missing", "n_extra", percent(F.col("similarity")).alias("structure_similarity"), F.col("passed").alias("structure_passed"))
        rows = rows.join(own, "pair_id", "left").fillna(False, ["structure_passed"])
    else:
        rows = rows.withColumns({"n_missing": F.lit(0), "n_extra": F.lit(0), "structure_similarity": F.lit(100.0), "structure_passed": F.lit(True), "n_top": F.lit(0)})
    kinds = ("n_critical", "n_warning", "n_info")
    if content is not None:
        own = content.select(F.col("doc_id").alias("target_doc_id"), "n_violations", *kinds, "n_chapters", F.col("passed").alias("content_passed"))
        rows = rows.join(own, "target_doc_id", "left")
    else:
        rows = rows.withColumns({"n_violations": F.lit(0), **dict.fromkeys(kinds, F.lit(0)), "n_chapters": F.lit(0), "content_passed": F.lit(True)})
    rows = rows.fillna(0).fillna(True)
    issues = (F.col("n_missing") + F.col("n_violations")).cast("long")
    checks = (F.col("n_top") + F.col("n_chapters") * rules_checked).cast("long")
    rate = F.when(checks > 0, percent((checks - issues) / checks)).otherwise(100.0)
    return rows.select(
        "pair_id", issues.alias("total_issues"), checks.alias("total_checks"), rate.alias("pass_rate"), (F.col("structure_passed") & F.col("content_passed")).alias("overall_passed"), "structure_passed", "content_passed",
        *[F.col(c).cast("long").alias(c) for c in ("template_chapters", "total_chapters", "n_missing", "n_extra", "n_violations", *kinds)], "structure_similarity",
    )


def detailed_statistics(chapters: DataFrame, results: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """document_summary with the numbers of chapters with and without violations. results: chapter_results rows."""
    by = results.groupBy("doc_id").agg(F.count_if(~F.col("passed")).alias("chapters_with_violations"), F.count_if(F.col("passed")).alias("chapters_without_violations"))
    return document_summary(chapters, images=images).join(by, "doc_id", "left").fillna(0, by.columns[1:])


def target_status(pairs: DataFrame, outline: DataFrame, extra: DataFrame) -> DataFrame:
    """Target rows with depth and status; a title is extra if any extra chapter (pair_id, g_seq) of the pair has it."""
    rows = pairs.select("pair_id", F.col("target_doc_id").alias("doc_id")).join(outline.select("doc_id", "seq", "title", "depth"), "doc_id")
    return _status(rows, extra.select("pair_id", F.col("g_seq").alias("seq")), "extra")


def outline_status(pairs: DataFrame, outline: DataFrame, mappings_missing: DataFrame) -> DataFrame:
    """Template rows with depth and status; a title is missing if any missing chapter of the pair has it."""
    rows = with_template(pairs.select("pair_id", "template_doc_id"), outline.select("doc_id", "seq", "title", "depth"))
    return _status(rows, mappings_missing.select("pair_id", F.col("t_seq").alias("seq")), "missing")


def _status(rows: DataFrame, some: DataFrame, status: str) -> DataFrame:
    lost = rows.join(some, ["pair_id", "seq"]).select("pair_id", "title").distinct().withColumn("status", F.lit(status))
    return rows.join(lost, ["pair_id", "title"], "left").fillna("matched", ["status"]).select("pair_id", "seq", "title", "depth", "status")
