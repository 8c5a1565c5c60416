"""The structure check as a job: tables of documents in, verdicts, mappings and missing chapters out.

    spark-submit folioscan/jobs/structure_check.py DOCUMENTS OUT
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from folioscan.operators import mapping, similarity, structure
from folioscan.sources import documents as D


def run(spark: SparkSession, source: str, out: str) -> None:
    docs = spark.read.parquet(source).select("doc_id", "text", "source")
    chapters, pairs = D.chapters_from_documents(docs), D.check_pairs(docs)
    mapping.map_chapters(pairs, chapters, similarity.strong_scores(pairs, chapters)).write.parquet(f"{out}/mappings")
    found = spark.read.parquet(f"{out}/mappings")
    D.write_result(mapping.missing_chapters(found), f"{out}/missing")
    D.write_result(structure.check_structure(docs, pairs, chapters, found), f"{out}/verdicts")


if __name__ == "__main__":
    run(SparkSession.builder.appName("structure-check").getOrCreate(), *sys.argv[1:3])
