"""Patterns of renumbered chapters between a template and a target, per pair and level.

All patterns start from numbered(): for each pair and level the numbered chapters of both sides, in one row. A document's chapters
are gathered once; templates, which are few and serve many pairs, are salted; and one pass over the rows finds all patterns. Offsets
are counted from histograms of (depth, last number), so no product of chapters is formed. Examples are (template number, target
number); those of insertions and deletions are the smallest numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.titles import number_sequence
from folioscan.operators.similarity import with_template

KEYS = ["pair_id", "level"]
COLUMNS = [*KEYS, "pattern_type", "offset_value", "confidence", "examples", "description"]
#: Types in the order in which a level's patterns are looked for.
TYPES = ("offset", "reorder", "insertion", "deletion", "mixed")
EXAMPLES, MERGED_EXAMPLES = 3, 5
#: The fewest numbers a side must have, and the least confidence, by type.
LEAST = {"offset": (2, 0.6), "reorder": (3, 0.3), "insertion": (2, 0.1), "deletion": (2, 0.1)}
FOUND = "pair_id long, level int, pattern_type string, offset_value long, confidence double, examples array<struct<t:string,g:string>>, description string"
_EXAMPLES = pa.list_(pa.struct([("t", pa.string()), ("g", pa.string())]))
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64(), _EXAMPLES, pa.string()]
#: From so many differences on, they are counted by numpy.
_MANY = 4096


def numbered(pairs: DataFrame, chapters: DataFrame) -> DataFrame:
    """pair_id, level, t and g: the numbered chapters (seq and nums) of the template and of the target at that level, in order. Levels
    at which a side has none are left out."""
    known = chapters.select("doc_id", F.col("level").cast("int").alias("level"), "seq", number_sequence(F.col("title")).alias("nums")).filter("nums is not null and level is not null")
    known = known.groupBy("doc_id", "level").agg(F.array_sort(F.collect_list(F.struct("seq", "nums"))).alias("t"))
    rows = with_template(pairs.select("pair_id", "template_doc_id", "target_doc_id"), known)
    return rows.join(known.select(F.col("doc_id").alias("target_doc_id"), "level", F.col("t").alias("g")), ["target_doc_id", "level"]).select(*KEYS, "t", "g")


def _text(nums: list[int]) -> str:
    return ".".join(map(str, nums))


def differences(t: list[int], g: list[int]) -> Counter:
    """How often each difference of a number of g and one of t occurs, from the numbers' own counts."""
    one, two, found = Counter(t), Counter(g), Counter()
    if len(one) * len(two) > _MANY and max(map(abs, (*one, *two))) < 1 << 61:
        b, m = np.array(list(two), np.int64), np.array(list(two.values()), np.int64)
        for a, n in one.items():
            found.update(dict(zip((b - a).tolist(), (m * n).tolist(), strict=True)))
        return found
    for a, n in one.items():
        for b, m in two.items():
            found[b - a] += n * m
    return found


def offset_of(t: list[tuple], g: list[tuple], least: int, share: float) -> tuple | None:
    """(offset, confidence, examples): the most frequent difference of last numbers over pairs of equal depth, unless it is 0; of
    equally frequent ones the first that occurs."""
    if len(t) < least or len(g) < least:
        return None
    sides: dict[int, tuple[list, list]] = {}
    for k, rows in enumerate((t, g)):
        for seq, nums in rows:
            sides.setdefault(len(nums), ([], []))[k].append((nums[-1], seq, nums))
    counts = Counter()
    for one, two in sides.values():
        if one and two:
            counts.update(differences([x[0] for x in one], [x[0] for x in two]))
    if not counts:
        return None
    most, total = max(counts.values()), sum(counts.values())
    # the first chapters of each number, by depth: enough to see which of the offsets comes first, and for the examples
    early = {}
    for depth, (one, two) in sides.items():
        early[depth] = ([], {})
        seen = Counter()
        for last, seq, nums in one:
            if seen[last] < EXAMPLES:
                early[depth][0].append((seq, last, nums))
                seen[last] += 1
        for last, seq, nums in two:
            held = early[depth][1].setdefault(last, [])
            if len(held) < EXAMPLES:
                held.append((seq, nums))

    def met(offset: int) -> list[tuple]:
        """(seq, seq, nums, nums) of its first pairs."""
        pairs = [(a, b, x, y) for one, two in early.values() for a, last, x in one for b, y in two.get(last + offset, ())]
        return sorted(pairs, key=lambda p: p[:2])[:EXAMPLES]

    tied = [k for k, n in counts.items() if n == most]
    best = min(tied, key=lambda k: met(k)[0][:2]) if len(tied) > 1 else tied[0]
    if best == 0 or most / total < share:
        return None
    return best, most / total, [(_text(x), _text(y)) for _, _, x, y in met(best)]


def reorder_of(t: list[tuple], g: list[tuple], least: int, share: float) -> tuple | None:
    """(confidence, examples): the same last numbers in another order; confidence is the share of places that keep theirs."""
    one, two = [x[1][-1] for x in t], [x[1][-1] for x in g]
    if len(one) < least or len(one) != len(two) or one == two or Counter(one) != Counter(two):
        return None
    moved = [(str(a), str(b)) for a, b in zip(one, two, strict=True) if a != b]
    confidence = 1.0 - len(moved) / len(one)
    return (confidence, moved[:EXAMPLES]) if confidence >= share else None


def new_numbers(here: list[tuple], there: list[tuple], least: int, share: float) -> tuple | None:
    """(confidence, how many, smallest): numbers of the longer side that the other lacks, by its distinct numbers."""
    if len(here) <= len(there) or len(there) < least:
        return None
    own, other = {tuple(x[1]) for x in here}, {tuple(x[1]) for x in there}
    new = own - other
    return (len(new) / len(own), len(new), [_text(x) for x in sorted(new)[:EXAMPLES]]) if new and len(new) / len(own) >= share else None


def patterns_of(level: int, t: list[tuple], g: list[tuple], least: dict[str, tuple[int, float]]) -> Iterator[tuple]:
    """Type, offset, confidence, examples and description of the patterns of one level, of the types in ``least``."""
    if "offset" in least and (x := offset_of(t, g, *least["offset"])):
        yield "offset", x[0], x[1], x[2], f"H{level} 章节编号整体偏移 {'+' if x[0] > 0 else ''}{x[0]}"
    if "reorder" in least and (x := reorder_of(t, g, *least["reorder"])):
        yield "reorder", 0, x[0], x[1], f"H{level} 章节顺序重新排列"
    if "insertion" in least and (x := new_numbers(g, t, *least["insertion"])):
        yield "insertion", 0, x[0], [("", n) for n in x[2]], f"H{level} 插入了 {x[1]} 个新章节"
    if "deletion" in least and (x := new_numbers(t, g, *least["deletion"])):
        yield "deletion", 0, x[0], [(n, "") for n in x[2]], f"H{level} 删除了 {x[1]} 个章节"


def all_patterns(rows: DataFrame, least: dict[str, tuple[int, float]] = LEAST) -> DataFrame:
    """The patterns of numbered() rows; see FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pair, level, *sides in zip(*[b.column(c).to_pylist() for c in ("pair_id", "level", "t", "g")], strict=True):
                t, g = ([(x["seq"], x["nums"]) for x in side] for side in sides)
                for kind, offset, confidence, examples, text in patterns_of(level, t, g, least):
                    out.append((pair, level, kind, offset, confidence, [{"t": x, "g": y} for x, y in examples], text))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], COLUMNS)

    return rows.mapInArrow(run, FOUND)


def offset_patterns(rows: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    return all_patterns(rows, {"offset": (least, share)})


def reorder_patterns(rows: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    return all_patterns(rows, {"reorder": (least, share)})


def insertion_patterns(rows: DataFrame, share: float = 0.1) -> DataFrame:
    return all_patterns(rows, {"insertion": (2, share)})


def deletion_patterns(rows: DataFrame, share: float = 0.1) -> DataFrame:
    return all_patterns(rows, {"deletion": (2, share)})


def mixed_patterns(pairs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Among levels that both sides have, some grew and some shrank. Levels come in the template's order."""
    per = chapters.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    t = with_template(pairs.select("pair_id", "template_doc_id"), per.withColumnRenamed("n", "n_t")).drop("template_doc_id")
    g = pairs.join(per.select(F.col("doc_id").alias("target_doc_id"), "level", F.col("n").alias("n_g")), "target_doc_id").select("pair_id", "level", "n_g")
    levels = F.transform(F.array_sort(F.collect_list(F.when(F.col("n_t") != F.col("n_g"), F.struct("first", "level")))), lambda x: x["level"])
    found = t.join(g, KEYS).groupBy("pair_id").agg(F.max(F.col("n_g") > F.col("n_t")).alias("grew"), F.max(F.col("n_g") < F.col("n_t")).alias("shrank"), levels.alias("affected_levels"))
    text = F.concat(F.lit("检测到混合重编号模式，影响层级: ["), F.array_join(F.col("affected_levels").cast("array<string>"), ", "), F.lit("]"))
    return found.filter("grew and shrank").select("pair_id", F.lit("mixed").alias("pattern_type"), "affected_levels", F.lit(0.7).alias("confidence"), text.alias("description"))


def merge_patterns(patterns: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """One row per pair and type; several levels lose their offset and keep the first examples. ``rank`` goes by confidence,
    then by the order in which the types were found."""
    by_level = F.array_sort(F.collect_list(F.struct("level", "examples", "description")))
    merged = patterns.groupBy("pair_id", "pattern_type").agg(
        F.array_sort(F.collect_set("level")).alias("affected_levels"), F.avg("confidence").alias("confidence"), F.when(F.count("*") == 1, F.first("offset_value")).otherwise(F.lit(0)).alias("offset_value"), by_level.alias("x"),
    )
    examples = F.slice(F.flatten(F.transform("x", lambda p: p["examples"])), 1, MERGED_EXAMPLES)
    merged = merged.select("pair_id", "pattern_type", "affected_levels", "confidence", "offset_value", examples.alias("examples"), F.array_join(F.transform("x", lambda p: p["description"]), "; ").alias("description"))
    if mixed is not None:
        none = F.array().cast(merged.schema["examples"].dataType)
        merged = merged.unionByName(mixed.select("pair_id", "pattern_type", "affected_levels", "confidence", F.lit(0).cast("long").alias("offset_value"), none.alias("examples"), "description"))
    place = F.array_position(F.array(*map(F.lit, TYPES)), F.col("pattern_type"))
    first = F.when(F.col("pattern_type") == "mixed", F.lit(None)).otherwise(F.element_at("affected_levels", 1))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("confidence"), F.asc_nulls_last(first), place)))


def detect_patterns(pairs: DataFrame, chapters: DataFrame) -> DataFrame:
    return merge_patterns(all_patterns(numbered(pairs, chapters)), mixed_patterns(pairs, chapters))


def shift_analysis(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """Per pair: whether there is any pattern, how many, the largest confidence, all levels and the descriptions by rank."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))), lambda x: x["description"]), "; ")
    levels = F.array_sort(F.array_distinct(F.flatten(F.collect_list("affected_levels"))))
    found = merged.groupBy("pair_id").agg(F.count("*").alias("n_patterns"), F.max("confidence").alias("max_confidence"), levels.alias("levels"), said.alias("summary"))
    rows = pairs.select("pair_id").join(found, "pair_id", "left").fillna(0, ["n_patterns", "max_confidence"]).fillna("", ["summary"])
    return rows.withColumn("has_shift", F.col("n_patterns") > 0).withColumn("levels", F.coalesce("levels", F.array().cast("array<int>")))


def validate_patterns(merged: DataFrame, pairs: DataFrame, chapters: DataFrame, least: float = 0.3) -> DataFrame:
    """merge_patterns rows with a column valid: confident, with levels; offsets are not 0 and have two examples or more, all of
    that offset; insertions and deletions agree with the chapter counts of the levels."""
    per = chapters.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    levels = merged.filter(F.col("pattern_type").isin("insertion", "deletion")).select("pair_id", "pattern_type", F.explode("affected_levels").alias("level")).join(pairs, "pair_id")
    t = with_template(pairs.select("pair_id", "template_doc_id"), per.withColumnRenamed("n", "n_t")).drop("template_doc_id")
    counts = levels.join(t, KEYS, "left").join(per.select(F.col("doc_id").alias("target_doc_id"), "level", F.col("n").alias("n_g")), ["target_doc_id", "level"], "left").fillna(0)
    counts = counts.groupBy("pair_id", "pattern_type").agg((F.sum("n_g") - F.sum("n_t")).alias("grown"))
    kind, last = F.col("pattern_type"), lambda x: F.element_at(F.split(x, r"\."), -1).cast("long")
    of_offset = F.forall("examples", lambda e: (e["t"] == "") | (e["g"] == "") | (F.size(F.split(e["t"], r"\.")) != F.size(F.split(e["g"], r"\."))) | (last(e["g"]) - last(e["t"]) == F.col("offset_value")))
    special = F.when(kind == "offset", (F.col("offset_value") != 0) & (F.size("examples") >= 2) & of_offset).when(kind == "insertion", F.col("grown") > 0).when(kind == "deletion", F.col("grown") < 0).otherwise(F.lit(True))
    rows = merged.join(counts, ["pair_id", "pattern_type"], "left")
    return rows.withColumn("valid", (F.col("confidence") >= least) & (F.size("affected_levels") > 0) & F.coalesce(special, F.lit(False))).drop("grown")
