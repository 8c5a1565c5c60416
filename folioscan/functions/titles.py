"""Scalar columns on titles and texts. Word, digit and space classes are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
SPACE = r"[\s\p{Z}]+"
#: Fixed values.
STOP_WORDS = ("的", "是", "在", "有", "和", "与", "或", "但", "而", "了", "着", "过")
GENERIC = ("(", "/", "XX", "某某", "可自行", "根据需要", "按需", "模块1", "模块2", "组件A", "组件B", "系统X", "流程x")
NAVIGATION = ("首页", "主页", "返回", "上一页", "下一页", "目录", "导航")
BOILERPLATE = (
    "^(编辑|修改|删除|分享|收藏|打印)$", "^(上传时间|修改时间|创建时间|发布时间)", r"^(作者|创建者|修改者)：[\s\p{Z}]*$", r"^(标签|分类|关键词)：[\s\p{Z}]*$", "^(点击|查看|下载|更多)$",
)
NAVIGATION_CLASSES = ("nav", "navigation", "menu", "breadcrumb", "sidebar", "footer", "header", "toolbar", "pagination", "toc", "shortcuts", "metadata", "actions", "controls")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_text(text: Column) -> Column:
    return F.coalesce(squeeze(text), F.lit(""))


def clean_title(title: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(title, r"^\p{Nd}+\.?[\s\p{Z}]*", ""), NOT_WORD, "")
    return F.lower(squeeze(bare))


def keywords(text: Column, least: int = 2, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words without digits and punctuation, which stand between them like spaces."""
    runs = F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{Nl}}\p{{No}}_]{{{least},}}"), F.lit(0))
    stop_words = tuple(w for w in stop_words if len(w) >= least)  # shorter ones are no words anyway
    return F.array_distinct(F.filter(runs, lambda w: ~w.isin(*stop_words)) if stop_words else runs)


def jaccard(a: Column, b: Column, both: Column | None = None) -> Column:
    """Of arrays without repeats; 0 if either is empty. both: how many they share, where that is worked out already."""
    both = F.size(F.array_intersect(a, b)) if both is None else both  # outside of any condition, so that it is worked out once
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def title_similarity(a: Column, b: Column, words_a: Column | None = None, words_b: Column | None = None, inclusion: float = 0.8, both: Column | None = None) -> Column:
    """Of cleaned titles; their keywords may be given where they were worked out before a join."""
    words_a, words_b = keywords(a) if words_a is None else words_a, keywords(b) if words_b is None else words_b
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), inclusion).otherwise(jaccard(words_a, words_b, both))


def content_similarity(a: Column, b: Column) -> Column:
    return jaccard(keywords(a), keywords(b))


def position_similarity(a: Column, b: Column, total: Column) -> Column:
    return F.when(total <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / (total - 1)))


def is_similar_title(a: Column, b: Column, verdict: Column | None = None) -> Column:
    """Equal or contained after cleaning; else a given verdict counts when both are longer than three characters."""
    x, y = clean_title(a), clean_title(b)
    close = (x == y) | F.contains(x, y) | F.contains(y, x)
    return close if verdict is None else close | ((F.length(x) > 3) & (F.length(y) > 3) & F.coalesce(verdict, F.lit(False)))


def is_generic_title(title: Column) -> Column:
    found = F.lit(False)
    for mark in GENERIC:
        found = found | F.contains(title, F.lit(mark))
    return found


def number_label(title: Column) -> Column:
    """The number that a title starts with, else its first ten characters."""
    t = F.trim(title)
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.coalesce(pick(r"^(\p{Nd}+(?:\.\p{Nd}+)*)"), pick(r"^第(\p{Nd}+)章"), pick(r"^第(\p{Nd}+)节"), F.substring(t, 1, 10))


def number_sequence(title: Column) -> Column:
    """The first dotted number in a title as an array, or null; numbers that no bigint holds count as none."""
    found = F.nullif(F.regexp_extract(title, r"([0-9]+(?:\.[0-9]+)*)", 1), F.lit(""))
    parts = F.transform(F.split(found, r"\."), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("bigint"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def parent_title(title: Column, level: Column, parent_path: Column) -> Column:
    t = F.trim(title)
    number = F.regexp_extract(t, r"^(\p{Nd}+)\.\p{Nd}+", 1)
    return (
        F.when(F.coalesce(parent_path, F.lit("")) != "", F.trim(F.element_at(F.split(parent_path, " > "), -1)))
        .when(number != "", F.concat(F.lit("第"), number, F.lit("级章节")))
        .when(level > 1, F.concat(F.lit("H"), (level - 1).cast("string"), F.lit("级章节")))
        .otherwise(F.lit(""))
    )


def is_valid_content(text: Column, link_chars: Column, class_attr: Column) -> Column:
    """Long enough, not mostly links, no navigation or boilerplate pattern or class."""
    t = F.trim(text)
    bad = (F.length(t) < 10) | ((link_chars > 0) & (F.length(text) > 0) & (link_chars / F.length(text) > 0.8))
    for word in NAVIGATION:
        bad = bad | F.rlike(text, F.lit(word + r"[\s\p{Z}]*[>›][\s\p{Z}]*"))
    for pattern in BOILERPLATE:
        bad = bad | F.rlike(t, F.lit(pattern))
    for name in NAVIGATION_CLASSES:
        bad = bad | F.contains(F.lower(F.coalesce(class_attr, F.lit(""))), F.lit(name))
    return ~bad
