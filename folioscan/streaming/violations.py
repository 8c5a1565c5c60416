"""Content rules on a stream of pages. The checks keep no state, so late or repeated pages need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators import rules


def page_stream(spark: SparkSession, path: str, schema: str = "doc_id long, seq int, title string, level int, content string", max_files: int = 100) -> DataFrame:
    """Chapters from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def write_violations(chapters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends title and code-fence violations with their severity until all present files are read."""
    found = rules.title_violations(chapters).unionByName(rules.code_fence_violations(chapters))
    rows = rules.with_severity(found, rules.severity_df(chapters.sparkSession))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
