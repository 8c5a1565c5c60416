"""Required chapters and the structure verdict of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.titles import clean_title
from folioscan.operators import mapping as M
from folioscan.operators import outline as O
from folioscan.operators import similarity as S

#: Fixed values.
REQUIRED = ("可靠性", "安全性")
MOST_MISSING = 3


def missing_critical(documents: DataFrame, chapters: DataFrame, required: tuple[str, ...] = REQUIRED, verdicts: DataFrame | None = None) -> DataFrame:
    """(doc_id, required) for each required word that no cleaned title of levels 1 to 3 contains, nor a verdict (doc_id, required) grants.

    The words are a parameter, so the pairs are documents times a handful of literals, made by explode."""
    words = F.explode(F.array(*map(F.lit, required))).alias("required")
    clean = clean_title(F.col("title"))
    hits = chapters.filter(F.col("level").between(1, 3)).select("doc_id", F.explode(F.filter(F.array(*map(F.lit, required)), lambda w: F.contains(clean, clean_title(w)))).alias("required"))
    found = hits if verdicts is None else hits.unionByName(verdicts.select("doc_id", "required"))
    return documents.select("doc_id", words).join(found.distinct(), ["doc_id", "required"], "left_anti")


def check_structure(documents: DataFrame, pairs: DataFrame, chapters: DataFrame, mappings: DataFrame, required: tuple[str, ...] = REQUIRED, most_missing: int = MOST_MISSING, verdicts: DataFrame | None = None) -> DataFrame:
    """Per pair: n_missing, n_extra, n_issues (level jumps of the target and missing required chapters), similarity, passed.

    A pair whose target has no chapters fails with all of the template's missing and similarity 0. verdicts: (doc_id, required) that
    another judge found to be there."""
    score = mappings.groupBy("pair_id").agg(F.count_if(M.is_missing()).alias("n_missing"), F.avg("confidence").alias("similarity"), F.count_if(F.col("g_seq").isNotNull()).alias("n_used"))
    per_doc = chapters.groupBy("doc_id").agg(F.count("*").alias("n"))
    jumps = O.level_issues(O.build_outline(chapters)).groupBy("doc_id").agg(F.count("*").alias("n_jumps"))
    critical = missing_critical(documents, chapters, required, verdicts).groupBy("doc_id").agg(F.count("*").alias("n_critical"))
    target = documents.select("doc_id").join(per_doc, "doc_id", "left").join(jumps, "doc_id", "left").join(critical, "doc_id", "left").fillna(0)
    rows = pairs.join(target, F.col("target_doc_id") == F.col("doc_id")).join(score, "pair_id", "left").fillna(0)
    issues = F.when(F.col("n") == 0, 1).otherwise(F.col("n_jumps") + F.col("n_critical"))
    rows = rows.select("pair_id", "n_missing", (F.col("n") - F.col("n_used")).alias("n_extra"), issues.cast("long").alias("n_issues"), "similarity")
    return rows.withColumn("passed", (F.col("n_missing") <= most_missing) & (F.col("n_issues") == 0))


def structure_check(documents: DataFrame, pairs: DataFrame, chapters: DataFrame, cfg: S.MappingConfig = S.CONFIG) -> DataFrame:
    scores = S.strong_scores(pairs, chapters, "text", cfg)
    return check_structure(documents, pairs, chapters, M.map_chapters(pairs, chapters, scores, cfg))
