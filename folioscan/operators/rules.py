"""Content rules of chapters and their counts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule sentences by category and the severity table, whose first key differs from its rule.
RULES = {
    "text_rules": (
        "文档标题必须使用规范的层级结构（H1、H2、H3等）", "代码示例必须包含完整的注释和说明", "每个章节必须有明确的标题", "技术术语必须保持一致性",
        "重要概念首次出现时应有详细解释", "列表项目必须使用统一的格式", "链接必须有效且描述清晰", "表格必须有表头和清晰的列标题",
    ),
    "image_rules": (
        "所有图表必须有清晰的标题和编号", "流程图中的每个步骤都应有明确标注", "架构图必须包含组件说明和连接关系", "截图必须清晰可读，关键信息可识别",
        "数据图表必须包含坐标轴标签和图例", "图片必须有相关的文字说明或说明文字", "技术示意图必须标注关键组件和流程", "界面截图必须突出显示重要功能区域",
    ),
    "structure_rules": ("文档必须包含目录结构", "章节编号必须连续且规范", "子章节层级不应超过4级", "每个主要章节应有概述或引言", "文档结尾应有总结或结论"),
    "format_rules": ("代码块必须指定编程语言", "引用内容必须标明出处", "专业名词必须使用正确的大小写", "数字和单位之间必须有空格", "中英文混排时必须有适当的空格"),
}
SEVERITY = {
    "critical": ("文档标题必须使用规范的层级结构", "所有图表必须有清晰的标题和编号", "代码示例必须包含完整的注释和说明"),
    "warning": ("图片必须有相关的文字说明或说明文字", "技术术语必须保持一致性", "数字和单位之间必须有空格"),
    "info": ("中英文混排时必须有适当的空格", "专业名词必须使用正确的大小写"),
}
TITLE_RULE, LEVEL_RULE, FENCE_RULE = "每个章节必须有明确的标题", "子章节层级不应超过4级", "代码块必须指定编程语言"
IMAGE_RULE, ALT_RULE = "图片必须有相关的文字说明或说明文字", "所有图表必须有清晰的标题和编号"
MOST_RULE_BYTES = 16 << 20
N_RULES = sum(map(len, RULES.values()))


def rules_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c) for c, rules in RULES.items() for r in rules], "rule string, category string")


def severity_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, s) for s, rules in SEVERITY.items() for r in rules], "rule string, severity string")


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """rule, category and rule, severity from a file of the form {rules: {category: [rule, ...]}, severity_levels: {severity: [rule,
    ...]}}, JSON or (by its name) YAML, from any store that Spark reads. The driver reads it, once, if it is at most MOST_RULE_BYTES.

    A part that is absent or null is empty. Of a rule that stands in several severities the last one counts; a rule that stands twice
    counts twice, as the reader of a file would count it. A file of another form is an error."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select("length").collect()
    if len(found) != 1 or found[0][0] > MOST_RULE_BYTES:
        raise ValueError(f"{path}: one file of at most {MOST_RULE_BYTES} bytes is asked for")
    text = bytes(files.select("content").first()[0]).decode("utf-8-sig")
    if path.endswith((".yaml", ".yml")):
        import yaml

        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    parts = [(given or {}).get(k) or {} for k in ("rules", "severity_levels")] if isinstance(given or {}, dict) else [None]
    if not all(isinstance(p, dict) and all(isinstance(x or [], list) and all(isinstance(r, str) for r in x or []) for x in p.values()) for p in parts):
        raise ValueError(f"{path}: lists of rules by category and by severity are asked for")
    rules = [(r, c) for c, some in parts[0].items() for r in some or []]
    severity = {r: s for s, some in parts[1].items() for r in some or []}
    return spark.createDataFrame(rules, "rule string, category string"), spark.createDataFrame(list(severity.items()), "rule string, severity string")


def title_violations(chapters: DataFrame, deepest: int = 4) -> DataFrame:
    blank = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit(TITLE_RULE))
    deep = F.when(F.col("level") > deepest, F.lit(LEVEL_RULE))
    return chapters.select("doc_id", "seq", F.explode(F.array_compact(F.array(blank, deep))).alias("rule"), F.lit(0).alias("number"))


def image_violations(chapters: DataFrame) -> DataFrame:
    """chapters with images array<struct<url, alt_text, description>>: no description and no alternative text are two violations."""
    rows = chapters.select("doc_id", "seq", F.posexplode("images").alias("number", "image"))
    empty = F.coalesce(F.trim("image.description"), F.lit(""))
    found = F.array_compact(F.array(F.when((empty == "") | F.contains(empty, F.lit("失败")), F.lit(IMAGE_RULE)), F.when(F.coalesce(F.trim("image.alt_text"), F.lit("")) == "", F.lit(ALT_RULE))))
    return rows.select("doc_id", "seq", F.explode(found).alias("rule"), "number")


def code_fence_violations(chapters: DataFrame) -> DataFrame:
    """Every fence that no word character follows, closing ones too, numbered from 1."""
    hits = F.regexp_extract_all("content", F.lit(r"```(?![\p{L}\p{N}_])"), F.lit(0))
    return chapters.select("doc_id", "seq", F.lit(FENCE_RULE).alias("rule"), F.explode(F.when(F.size(hits) > 0, F.sequence(F.lit(1), F.size(hits)))).alias("number"))


class Matcher:
    """Rules as compiled patterns and one automaton over a literal that each pattern's matches must hold.

    A text is read once by the automaton; only patterns whose literal it has, and those that need none, are tried on it."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.always, self.words = [re.compile(p) for p in patterns], [], {}
        for i, p in enumerate(patterns):
            word = required_literal(p)
            self.words.setdefault(word, []).append(i) if word else self.always.append(i)
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def hits(self, text: str | None) -> list[int]:
        if text is None:
            return []
        if self.automaton is None and self.words:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, rules in self.words.items():
                self.automaton.add_word(word, rules)
            self.automaton.make_automaton()
        tried = set(self.always)
        for _, rules in self.automaton.iter(text) if self.automaton else ():
            tried.update(rules)
        return [i for i in sorted(tried) if self.patterns[i].search(text)]


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern holds; empty if there is none to be seen. Alternatives,
    optional parts and patterns that ignore case or spaces in themselves give none."""
    if re.compile(pattern).flags & (re.IGNORECASE | re.VERBOSE | re.LOCALE) or "(?" in pattern:
        return ""
    best, run, i, depth = "", "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        more = pattern[i + 1 : i + 2]
        if c == "\\":
            if more.isdigit() or more in "xuUN":  # a character by its number, or what a group held
                return ""
            c, known = more, not more.isalnum()
            i, more = i + 2, pattern[i + 2 : i + 3]
        else:
            known = c not in ".^$*+?{}[]|()"
            i += 1
        if c == "|" and not known:
            return ""  # either side will do
        if c == "[" and not known:
            i = _after_class(pattern, i)
            best, run = max(best, run, key=len), ""
            continue
        if c == "(" and not known:  # a group's content is left out
            best, run, depth = max(best, run, key=len), "", 1
            while i < len(pattern) and depth:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i = _after_class(pattern, i + 1) - 1
                else:
                    depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += 1
            continue
        if c == "{" and not known and (count := re.match(r"[0-9]*,?[0-9]*}", pattern[i:])):
            i += count.end()
        if not known:
            best, run = max(best, run, key=len), ""
        elif more in ("*", "?", "{"):  # may be absent, or stand more than once
            best, run = max(best, run, key=len), ""
        elif more == "+":
            best, run = max(best, run + c, key=len), ""
        else:
            run += c
    return max(best, run, key=len)


def _after_class(pattern: str, i: int) -> int:
    """Where a character class ends whose bracket stands before i."""
    i += pattern[i : i + 1] == "^"
    i += pattern[i : i + 1] == "]"
    while i < len(pattern) and pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i + 1


def compiled_rules(rules: DataFrame) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(name, pattern, severity) of the rules that compile, and (name, pattern, error) of the others. The rules are a table that a
    user writes; one of more than MOST_RULE_BYTES is refused before it is read. A null severity is a warning."""
    size = rules.agg(F.sum(F.coalesce(F.octet_length("pattern"), F.lit(0)) + F.coalesce(F.octet_length("name"), F.lit(0)) + 16)).first()[0] or 0
    if size > MOST_RULE_BYTES:
        raise ValueError(f"rules of {size} bytes, more than {MOST_RULE_BYTES}")
    good, bad = [], []
    for name, pattern, severity in rules.select("name", "pattern", "severity").collect():
        try:
            if pattern is None:
                raise re.error("no pattern")
            re.compile(pattern)
            good.append((name, pattern, severity or "warning"))
        except (re.error, OverflowError, RecursionError) as e:
            bad.append((name, pattern, str(e)))
    return good, bad


def broken_rules(rules: DataFrame) -> DataFrame:
    """name, pattern and error of the rules that do not compile."""
    return rules.sparkSession.createDataFrame(compiled_rules(rules)[1], "name string, pattern string, error string")


def regex_rule_violations(chapters: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, seq, rule, severity: chapters whose content a rule's pattern (name, pattern, severity) finds, with Python's regular
    expressions. Contents are read once, whatever the number of rules; rules that do not compile are in broken_rules()."""
    good, _ = compiled_rules(rules)
    held = rules.sparkSession.sparkContext.broadcast((Matcher([p for _, p, _ in good]), [n for n, _, _ in good], [s for _, _, s in good]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, names, severities = held.value
        for b in batches:
            found = [(r, i) for r, text in enumerate(b.column("content").to_pylist()) for i in matcher.hits(text)]
            at = pa.array([r for r, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("seq").take(at), pa.array([names[i] for _, i in found], pa.string()), pa.array([severities[i] for _, i in found], pa.string())], ["doc_id", "seq", "rule", "severity"])

    return chapters.select(F.col("doc_id").cast("long"), F.col("seq").cast("int"), F.col("content").cast("string")).mapInArrow(run, "doc_id long, seq int, rule string, severity string")


def with_severity(violations: DataFrame, severity: DataFrame) -> DataFrame:
    """By exact rule text; a rule that the table does not hold is a warning."""
    return violations.join(severity, "rule", "left").fillna("warning", ["severity"])


def chapter_results(chapters: DataFrame, violations: DataFrame, rules_checked: int = N_RULES) -> DataFrame:
    counts = violations.groupBy("doc_id", "seq").agg(F.count("*").alias("n_violations"))
    rows = chapters.select("doc_id", "seq").join(counts, ["doc_id", "seq"], "left").fillna(0)
    return rows.select("doc_id", "seq", "n_violations", (F.col("n_violations") == 0).alias("passed"), F.lit(rules_checked).alias("rules_checked"))


def content_results(chapters: DataFrame, violations: DataFrame, severities: tuple[str, ...] = tuple(SEVERITY)) -> DataFrame:
    """Per document: chapters, violations, by severity with zeros, passed. ``severities``: the ones that get a column."""
    by = violations.groupBy("doc_id").agg(F.count("*").alias("n_violations"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in severities])
    rows = chapters.groupBy("doc_id").agg(F.count("*").alias("n_chapters")).join(by, "doc_id", "left").fillna(0)
    return rows.withColumn("passed", F.col("n_violations") == 0)


def rule_counts(violations: DataFrame) -> DataFrame:
    """Per document and rule: how often it is violated."""
    return violations.groupBy("doc_id", "rule").agg(F.count("*").alias("n_violations"))


def rules_summary(rules: DataFrame, severity: DataFrame) -> DataFrame:
    return with_severity(rules, severity).groupBy("category", "severity").agg(F.count("*").alias("n_rules"))
