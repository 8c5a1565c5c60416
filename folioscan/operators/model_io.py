"""Requests for and replies of a language model as tables; no model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators.similarity import with_template

#: Fixed value.
SCORE_MARKER = "SIMILARITY_MATRIX:"


def render_list(items: Column, prefix: str) -> Column:
    """Numbered lines: prefix1: ..., prefix2: ..."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def semantic_requests(pairs: DataFrame, chapters: DataFrame, small: int = 400, medium: int = 10_000, size: int = 10) -> DataFrame:
    """pair_id, batch, template_titles, target_titles: one request for small pairs, batches of template titles for medium ones.

    Pairs are counted first, so no titles are gathered for those above ``medium`` cells."""
    counts = chapters.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = with_template(pairs.select("pair_id", "template_doc_id", "target_doc_id"), counts.withColumnRenamed("n", "n_t"))
    asked = asked.join(counts.select(F.col("doc_id").alias("target_doc_id"), F.col("n").alias("n_g")), "target_doc_id").filter(F.col("n_t") * F.col("n_g") <= medium)
    ids = asked.select(F.explode(F.array("template_doc_id", "target_doc_id")).alias("doc_id")).distinct()
    titles = chapters.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]).alias("titles"))
    rows = with_template(asked, titles.withColumnRenamed("titles", "t")).join(titles.select(F.col("doc_id").alias("target_doc_id"), F.col("titles").alias("g")), "target_doc_id")
    rows = rows.withColumn("step", F.when(F.col("n_t") * F.col("n_g") <= small, F.col("n_t")).otherwise(size).cast("int"))
    rows = rows.select("pair_id", "t", "g", "step", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / F.col("step")).cast("int"))).alias("batch"))
    return rows.select("pair_id", "batch", F.slice("t", F.col("batch") * F.col("step") + 1, F.col("step")).alias("template_titles"), F.col("g").alias("target_titles"))


def context_info(rows: DataFrame, siblings: int = 3) -> DataFrame:
    """Context lines for each template chapter: level, parent path, 1-based position, patterns and the last mappings before it.

    rows: pair_id, t_seq, level, parent_path, position, patterns (text or null), t_title, g_title (null if unmapped)."""
    said = F.when(F.col("g_title").isNotNull(), F.concat("t_title", F.lit(" → "), "g_title"))
    before = F.collect_list(F.coalesce(said, F.lit(""))).over(Window.partitionBy("pair_id").orderBy("level", "t_seq").rowsBetween(-siblings, -1))
    last = F.array_join(F.filter(before, lambda x: x != ""), "; ")
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    lines = [
        F.concat(F.lit("章节层级: H"), F.col("level").cast("string")), line("父章节路径: ", F.col("parent_path")), F.concat(F.lit("章节位置: 第"), (F.col("position") + 1).cast("string"), F.lit("个")),
        line("检测到的重编号模式: ", F.col("patterns")), line("同级章节映射: ", F.col("_last")),
    ]
    return rows.withColumn("_last", last).select("pair_id", "t_seq", F.concat_ws("\n", *lines).alias("context"))


def parse_score_lines(replies: DataFrame) -> DataFrame:
    """request_id, t, g, score, reason from lines 'T1-G2: 0.9 | 原因：...' after the marker; a cell's last line wins.

    replies: request_id, n_t, n_g (titles asked about; cells beyond them are ignored) and text. Scores are held to 0..1. A score
    that is no number ends the reply."""
    after = F.element_at(F.split("text", SCORE_MARKER, 2), 2)
    pattern = r"^T([0-9]+)-G([0-9]+):[\s\p{Z}]*([0-9.]+)[\s\p{Z}]*\|[\s\p{Z}]*原因：(.+)"
    rows = replies.filter(F.contains("text", F.lit(SCORE_MARKER))).select("request_id", "n_t", "n_g", F.posexplode(F.split(after, "\n", -1)).alias("line", "said"))
    rows = rows.withColumn("said", F.regexp_replace("said", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).filter(F.rlike("said", F.lit(pattern)))
    part = lambda i: F.regexp_extract("said", pattern, i)
    rows = rows.select("request_id", "n_t", "n_g", "line", part(1).try_cast("int").alias("t"), part(2).try_cast("int").alias("g"), part(3).try_cast("double").alias("score"), F.trim(part(4)).alias("reason"))
    bad = F.min(F.when(F.col("score").isNull(), F.col("line"))).over(Window.partitionBy("request_id"))
    rows = rows.withColumn("bad", bad).filter("bad is null or line < bad").filter("t between 1 and n_t and g between 1 and n_g")
    best = rows.groupBy("request_id", "t", "g").agg(F.max_by(F.struct("score", "reason"), "line").alias("x"))
    return best.select("request_id", "t", "g", F.least(F.lit(1.0), "x.score").alias("score"), "x.reason")


def parse_candidates(replies: DataFrame) -> DataFrame:
    """request_id, candidate, score and reason: the best candidate of each reply from lines '候选1: 0.9 | 原因：...'.

    replies: request_id, n_candidates and text. A line counts from its start, with a reason; candidates that were not asked about are
    passed over, scores are taken as they are, and only one above 0 is an answer; the first wins ties. A score that is no number
    ends the reply: what stood before it counts. Digits may be full-width."""
    pattern = r"^候选(\p{Nd}+):[\s\p{Z}]*([\p{Nd}.]+)[\s\p{Z}]*\|[\s\p{Z}]*原因：(.+)"
    rows = replies.select("request_id", "n_candidates", F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    rows = rows.withColumn("said", F.regexp_replace("said", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).filter(F.rlike("said", F.lit(pattern)))
    part = lambda i: F.regexp_extract("said", pattern, i)
    ascii_digits = lambda x: F.translate(x, "０１２３４５６７８９", "0123456789")
    rows = rows.select("request_id", "n_candidates", "line", ascii_digits(part(1)).try_cast("long").alias("candidate"), ascii_digits(part(2)).try_cast("double").alias("score"), F.regexp_replace(part(3), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("reason"))
    bad = F.min(F.when(F.col("score").isNull(), F.col("line"))).over(Window.partitionBy("request_id"))
    rows = rows.withColumn("bad", bad).filter("bad is null or line < bad").filter("candidate between 1 and n_candidates and score > 0")
    best = rows.groupBy("request_id").agg(F.max_by(F.struct("candidate", "score", "reason"), F.struct("score", -F.col("line"))).alias("x"))
    return best.select("request_id", F.col("x.candidate").cast("int").alias("candidate"), "x.score", "x.reason")


def parse_violations(replies: DataFrame) -> DataFrame:
    """Violations from blocks of keyed lines; a line that starts with 违规项 opens a block, a repeated key overwrites.

    replies: request_id, text and, for violations that name no position, the chapter's title."""
    lines = replies.filter(~F.contains("text", F.lit("未发现违规项"))).select("request_id", "title", F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    lines = lines.withColumn("said", F.trim("said"))
    opens = F.startswith("said", F.lit("违规项"))
    block = F.sum(opens.cast("int")).over(Window.partitionBy("request_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    keys = {"rule": "规范:", "content": "内容:", "position": "位置:", "suggestion": "建议:"}
    key = F.coalesce(*[F.when(F.startswith("said", F.lit(p)), F.lit(k)) for k, p in keys.items()])
    rows = lines.withColumn("block", block).withColumn("key", key).filter("key is not null").withColumn("value", F.trim(F.substring("said", 4, 1 << 30)))
    last = [F.coalesce(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line"))), F.lit("")).alias(k) for k in keys]
    found = rows.groupBy("request_id", "block").agg(*last, F.first("title").alias("title")).filter("rule <> '' and content <> ''")
    found = found.withColumn("position", F.when(F.col("position") == "", F.concat(F.lit("章节: "), "title")).otherwise(F.col("position"))).drop("title")
    return found.withColumn("content_type", F.when(F.contains("content", F.lit("图")), "image").otherwise("text")).withColumn("suggestion", F.when(F.col("suggestion") == "", "请根据规范要求进行修改").otherwise(F.col("suggestion")))


def parse_yes_no(reply: Column) -> Column:
    return F.contains(reply, F.lit("是"))


def distinct_title_pairs(scores: DataFrame) -> DataFrame:
    return scores.select("title1", "title2").distinct()


class Answers:
    """Answers about pairs of titles (title1, title2, score, reason), kept over runs in a table at ``path``.

    A run's answers are one partition of it, which a repeated run replaces as a whole: writers work beside the table and move the
    partition in when all of it is there. A pair of titles has at most one answer, the first run's. Titles may be null."""

    SCHEMA = "title1 string, title2 string, score double, reason string, run string"
    KEYS = ("title1", "title2")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All answers; none if there is no table yet."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return a["title1"].eqNullSafe(b["title1"]) & a["title2"].eqNullSafe(b["title2"])

    def to_ask(self, title_pairs: DataFrame) -> DataFrame:
        """The pairs of titles, each once, that have no answer yet."""
        return self._without(title_pairs.select(*self.KEYS), self.rows(), F.lit(True)).select(*self.KEYS)

    def _without(self, rows: DataFrame, known: DataFrame, x: Column) -> DataFrame:
        """KEYS and the least x of the rows' pairs of titles that ``known`` has none of: one grouping of both tables, which leaves rows
        where they are if both are dealt by KEYS already, as those of to_ask() are."""
        both = rows.select(*self.KEYS, x.alias("x"), F.lit(0).alias("known")).unionAll(known.select(*self.KEYS, F.lit(None).alias("x"), F.lit(1).alias("known")))
        return both.groupBy(*self.KEYS).agg(F.min("x").alias("x"), F.max("known").alias("known")).filter("known = 0").drop("known")

    def save(self, answers: DataFrame, run: str) -> None:
        """Adds the run's answers to pairs that other runs have not answered; of several to one pair the best, then the reason that
        sorts first. A run that is saved again with the same answers changes nothing."""
        others = self.rows().filter(F.col("run") != run).repartition(*self.KEYS)
        best = self._without(answers.filter("score is not null"), others, F.struct((-F.col("score")).alias("s"), "reason"))
        fresh = best.select(*self.KEYS, (-F.col("x.s")).alias("score"), "x.reason", F.lit(run).alias("run"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(self.path)

    def scores(self, cells: DataFrame) -> DataFrame:
        """pair_id, t_seq, g_seq, score of the cells (with title1 and title2) that have an answer, as pair_scores takes them. Cells of
        one pair of titles, of which there may be many, are dealt by their own keys only after the join; the answer is one row."""
        known = self.rows()
        return cells.join(known, self._same(cells, known)).select("pair_id", "t_seq", "g_seq", "score")
