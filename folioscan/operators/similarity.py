"""Scores of every template chapter against every target chapter of a pair."""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import titles as T
from folioscan.sources.documents import work_path

SALTS = 32
HOT_PAIRS = 20_000
BLOCK = 1024
DENSE = 10_000
#: So many templates' ids, a few MB, are broadcast at most.
FEW = 100_000
EPS = 1e-9


@dataclass(frozen=True)
class MappingConfig:
    similarity: float = 0.4
    exact: float = 0.95
    semantic: float = 0.6
    title_weight: float = 0.3
    content_weight: float = 0.2
    position_weight: float = 0.2
    structure_weight: float = 0.3


CONFIG = MappingConfig()


def base_score(title: Column, content: Column, position: Column, structure: Column, cfg: MappingConfig = CONFIG) -> Column:
    return title * cfg.title_weight + content * cfg.content_weight + position * cfg.position_weight + structure * cfg.structure_weight


def fused_score(base: Column, s: Column) -> Column:
    return F.when(s >= 0.85, base * 0.2 + s * 0.8).when(s >= 0.7, base * 0.4 + s * 0.6).when(s > 0, base * 0.6 + s * 0.4).otherwise(base)


def confidence(title: Column, content: Column, position: Column, structure: Column) -> Column:
    """Recomputed for a chosen pair with weights of its own, not the score that chose it."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), title * 0.4 + content * 0.3 + position * 0.2 + structure * 0.1))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def match_type(overall: Column, title: Column, position: Column, cfg: MappingConfig = CONFIG) -> Column:
    return F.when(overall >= cfg.exact, "exact").when(title >= 0.8, "similar").when(overall >= cfg.semantic, "semantic").when(position >= 0.7, "positional").otherwise("none")


def features(chapters: DataFrame) -> DataFrame:
    """What the scores need of a chapter, worked out once: no text goes through the join of pairs. Words are 64-bit hashes, on
    which arrays are compared several times faster; two words of a vocabulary of ten million agree with a chance of 3e-6.
    title_bits has a bit for each title word, of 64: titles without a bit in common share no word."""
    names = ["doc_id", "seq", "level", "position", "clean", "words", "title_words", "title_bits"]
    # generators, so that what later columns build on is worked out once
    rows = chapters.select("doc_id", "seq", "level", "position", "content", F.explode(F.array(T.clean_title(F.col("title")))).alias("clean"))
    rows = rows.select("*", F.explode(F.array(_hashes(T.keywords(F.col("clean"))))).alias("title_words"))
    bits = F.aggregate("title_words", F.lit(0).cast("long"), lambda x, w: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))))
    return rows.withColumns({"words": _hashes(T.keywords(F.col("content"))), "title_bits": bits}).select(names)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def with_template(pairs: DataFrame, rows: DataFrame, salts: int = SALTS, keep: bool = False, known: bool = False, least: int = HOT_PAIRS) -> DataFrame:
    """pairs with each of the template's rows (doc_id and others); keep: also pairs without any; known: the rows are those of templates only.

    One template may serve a third of all pairs. Templates of ``least`` pairs or more are hot: their ids, of which there are at most
    the pairs divided by ``least`` (4 MB for 10^10 pairs), are broadcast, their pairs dealt to ``salts`` parts and their rows go to
    each part. The rows of other templates are sent once."""
    counts = pairs.groupBy("template_doc_id").agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") >= least).select(F.col("template_doc_id").alias("_hot"))
    templates = rows if known else rows.join(counts.select(F.col("template_doc_id").alias("doc_id")), "doc_id", "left_semi")
    templates = templates.withColumnRenamed("doc_id", "template_doc_id").join(F.broadcast(hot), F.col("template_doc_id") == F.col("_hot"), "left")
    templates = templates.withColumn("salt", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("_hot")
    dealt = pairs.join(F.broadcast(hot), F.col("template_doc_id") == F.col("_hot"), "left")
    dealt = dealt.withColumn("salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("pair_id"), F.lit(salts)).cast("int"))).drop("_hot")
    return dealt.join(templates, ["template_doc_id", "salt"], "left" if keep else "inner").drop("salt")


def large_pairs(pairs: DataFrame, chapters: DataFrame, dense: int = DENSE) -> DataFrame:
    """The pairs of over ``dense`` cells."""
    counts = chapters.groupBy("doc_id").agg(F.count("*").alias("_n"))
    rows = with_template(pairs.select("pair_id", "template_doc_id", "target_doc_id"), counts)
    rows = rows.join(counts.select(F.col("doc_id").alias("target_doc_id"), F.col("_n").alias("_g")), "target_doc_id")
    return rows.filter(F.col("_n") * F.col("_g") > dense).drop("_n", "_g")


def _sides(pairs: DataFrame, chapters: DataFrame, block: int, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Template chapters for every pair and block of its target (t_ columns, n and g_n: how many the two have), and target chapters
    with their block (g_ columns)."""
    part = F.floor(F.col("seq") / block).cast("long")
    counts = (chapters if places is None else places).groupBy("doc_id", part.alias("block")).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    targets = counts.select(F.col("doc_id").alias("target_doc_id"), F.col("n").alias("g_n"), F.explode("blocks").alias("block"))
    asked = pairs.select("pair_id", "template_doc_id", "target_doc_id").join(targets, "target_doc_id")
    ids = pairs.select(F.col("template_doc_id").alias("doc_id")).distinct()
    few = ids.limit(FEW + 1).count() <= FEW  # then the other chapters' texts are not sent anywhere
    templates = features(chapters.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
    t = with_template(asked, templates.join(counts.drop("blocks"), "doc_id").select("doc_id", "n", *[F.col(c).alias(f"t_{c}") for c in templates.columns[1:]]), known=True)
    known = features(chapters)
    g = known.select(F.col("doc_id").alias("target_doc_id"), part.alias("block"), *[F.col(c).alias(f"g_{c}") for c in known.columns[1:]])
    return t, g


_SIMS = ["title_sim", "content_sim", "position_sim", "structure_sim"]
_CELL = ["pair_id", "t_seq", "g_seq", "t_level", "g_level"]


def _common(words: str, bits: str | None = None) -> Column:
    """_both: how many words the two sides share, as a generator; bits: those of the words, which tell most cells without any."""
    both = F.size(F.array_intersect(f"t_{words}", f"g_{words}"))
    both = both if bits is None else F.when(F.col(f"t_{bits}").bitwiseAND(F.col(f"g_{bits}")) == 0, 0).otherwise(both)
    return F.inline(F.array(F.struct(both.alias("_both"))))


def _parts(both: Column | None = None) -> list[Column]:
    """Title, content, position and structure similarity of a joined row; both: the number of words in common of the sets asked about."""
    title = T.title_similarity(F.col("t_clean"), F.col("g_clean"), F.col("t_title_words"), F.col("g_title_words"), both=both)
    content = T.jaccard(F.col("t_words"), F.col("g_words"), both)
    position = T.position_similarity(F.col("t_position"), F.col("g_position"), F.col("n"))
    return [title, content, position, F.when(F.col("t_level") == F.col("g_level"), 1.0).otherwise(0.0)]


def _exact() -> list[Column]:
    return [part.alias(name) for part, name in zip(_parts(), _SIMS, strict=True)]


def _fused(cfg: MappingConfig) -> Column:
    return fused_score(base_score(*map(F.col, _SIMS), cfg), F.col("semantic"))


def _with_semantic(rows: DataFrame, semantic: str | DataFrame) -> DataFrame:
    if isinstance(semantic, DataFrame):
        given = semantic.select("pair_id", "t_seq", "g_seq", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("semantic"))
        return rows.join(given, ["pair_id", "t_seq", "g_seq"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    return rows.withColumn("semantic", F.col("title_sim") if semantic == "text" else F.lit(0.0))


def pair_scores(pairs: DataFrame, chapters: DataFrame, semantic: str | DataFrame = "text", cfg: MappingConfig = CONFIG, block: int = BLOCK) -> DataFrame:
    """pair_id, t_seq, g_seq, both levels, the four similarities, the semantic score and overall, for every cell.

    semantic: 'text' takes the title similarity, 'none' 0, a DataFrame (pair_id, t_seq, g_seq, score) its scores. The join is
    on the target and blocks of its chapters (by seq, ``block`` in each), so a very long document is several tasks."""
    t, g = _sides(pairs, chapters, block)
    rows = t.join(g, ["target_doc_id", "block"]).select(*_CELL, *_exact())
    return _with_semantic(rows, semantic).withColumn("overall", _fused(cfg))


def _size_ratio(words: str) -> Column:
    """The most that two sets' similarity can be."""
    a, b = F.size(f"t_{words}"), F.size(f"g_{words}")
    return F.coalesce(F.try_divide(F.least(a, b), F.greatest(a, b)), F.lit(0.0))


def _may_agree(semantic: str | DataFrame, cfg: MappingConfig) -> Column:
    """Of cells of two levels, at most two apart, only those whose titles can be as similar as they must; nothing costly is worked out."""
    apart, least = F.abs(F.col("t_level") - F.col("g_level")), _least_title(cfg, semantic)
    if not isinstance(semantic, str) or least <= EPS:
        return apart <= 2
    held = F.contains("t_clean", "g_clean") | F.contains("g_clean", "t_clean")
    return (apart == 0) | (apart <= 2) & (held | (F.col("t_title_bits").bitwiseAND(F.col("g_title_bits")) != 0) & (_size_ratio("title_words") >= least - EPS))


def is_strong(cfg: MappingConfig = CONFIG) -> Column:
    """The cells that a mapping can use: those of one level from the lower bound on, those one or two levels apart from the higher."""
    apart = F.abs(F.col("t_level") - F.col("g_level"))
    return ((apart == 0) & (F.col("overall") >= cfg.similarity)) | (apart.between(1, 2) & (F.col("overall") >= cfg.semantic))


def strong_scores(pairs: DataFrame, chapters: DataFrame, semantic: str | DataFrame = "text", cfg: MappingConfig = CONFIG, block: int = BLOCK, dense: int = DENSE, places: DataFrame | None = None) -> DataFrame:
    """The rows of pair_scores that are strong, without making the others where a pair has over ``dense`` cells.

    A score is a mean of its parts and of the semantic score, so it is at most the larger of the two; from level and position, title
    words, and the sizes of word sets follows what it can reach. Pairs of up to ``dense`` cells (as many as one request may ask a
    model about) are joined by target, and contents are compared where the bound leaves it open; whether there are larger ones, which go
    by candidates(), is counted at once. places: doc_id and seq of the chapters, where a smaller table holds them."""
    t, g = _sides(pairs, chapters, block, places)
    title, content, position, structure = _parts(F.col("_both"))
    ratio = _size_ratio("words")
    # generators, since a filter is not moved below one: what it tests is worked out once a cell, and so are the words in common
    rows = t.filter(F.col("n") * F.col("g_n") <= dense).join(g, ["target_doc_id", "block"]).filter(_may_agree(semantic, cfg)).select("*", _common("title_words", "title_bits"))
    rows = rows.select(*_CELL, "t_words", "g_words", F.inline(F.array(F.struct(title.alias("title_sim"), position.alias("position_sim"), structure.alias("structure_sim"), ratio.alias("ratio")))))
    if isinstance(semantic, str):
        reach = base_score(F.col("title_sim"), F.col("ratio"), F.col("position_sim"), F.col("structure_sim"), cfg)
        reach = F.greatest(reach, F.col("title_sim")) if semantic == "text" else reach
        rows = rows.filter(reach >= F.when(F.col("structure_sim") == 1, cfg.similarity - EPS).otherwise(cfg.semantic - EPS))
    small = rows.select("*", _common("words")).select(*_CELL, "title_sim", content.alias("content_sim"), "position_sim", "structure_sim")
    many = large_pairs(pairs, chapters if places is None else places, dense)
    found = small if many.isEmpty() else small.unionByName(_of_large(many, chapters, semantic, cfg))
    return _with_semantic(found, semantic).withColumn("overall", _fused(cfg)).filter(is_strong(cfg))


def _of_large(pairs: DataFrame, chapters: DataFrame, semantic: str | DataFrame, cfg: MappingConfig) -> DataFrame:
    """The candidates of large pairs with their exact parts. These pairs and their chapters are kept as tables first: they are few and
    read many times."""
    pairs = kept(pairs, "large-pairs")
    own = kept(chapters.join(pairs.select(F.explode(F.array("template_doc_id", "target_doc_id")).alias("doc_id")).distinct(), "doc_id", "left_semi"), "large-chapters")
    t, g = _sides(pairs, own, 1 << 40)
    t = t.drop("block").dropDuplicates(["pair_id", "t_seq"])
    cells = candidates(pairs, own, semantic, cfg)
    return cells.join(t, ["pair_id", "t_seq"]).join(g.drop("block"), ["target_doc_id", "g_seq"]).select(*_CELL, *_exact())


def kept(rows: DataFrame, what: str) -> DataFrame:
    """The rows as a table of the job's own, for what is read more than once."""
    path = work_path(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _least_title(cfg: MappingConfig, semantic: str | DataFrame) -> float:
    """The title similarity from which a cell of two levels can be strong, whatever its content and place."""
    alone = (cfg.semantic - cfg.content_weight - cfg.position_weight) / cfg.title_weight if cfg.title_weight else 2.0
    return min(alone, cfg.semantic) if isinstance(semantic, str) and semantic == "text" else alone


def candidates(pairs: DataFrame, chapters: DataFrame, semantic: str | DataFrame = "text", cfg: MappingConfig = CONFIG) -> DataFrame:
    """pair_id, t_seq, g_seq of all cells that can be strong (and of some that are not), by equal keys, each once.

    Of one level: cells whose places are near enough to count, by ranges of places; and of the others those that share a word of
    their titles or contents. Of two levels: those that share a title word. Words go rarest first, and only as many of each set as
    must hold a common one if the sets agree to the share that the bounds ask for. Titles that contain one another are found by the
    shorter one's first two characters. Cells with a given score are candidates by that."""
    spare = cfg.similarity - cfg.structure_weight  # what title, content and place must bring to a cell of one level
    least = _least_title(cfg, semantic)
    if spare <= 0 or least <= 0:
        raise ValueError("with these weights every cell can be strong; use pair_scores")
    counts = chapters.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = pairs.select("pair_id", "template_doc_id", "target_doc_id")
    # of one level and near: |difference of places| < n - 1
    place = chapters.select("doc_id", "seq", "level", "position")
    width = F.greatest(F.col("n") - 1, F.lit(1))
    sizes = with_template(asked, counts)
    t = with_template(sizes, place.withColumnRenamed("seq", "t_seq")).withColumnRenamed("position", "at")
    t = t.withColumn("bin", F.when(F.col("n") <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / width) + d)))
    t = t.select("pair_id", "target_doc_id", "n", "t_seq", "level", "at", F.explode("bin").alias("bin"))
    g = sizes.join(place.select(F.col("doc_id").alias("target_doc_id"), F.col("seq").alias("g_seq"), "level", F.col("position").alias("g_at")), "target_doc_id")
    g = g.select("pair_id", "g_seq", "level", "g_at", F.when(F.col("n") <= 1, F.lit(0).cast("long")).otherwise(F.floor(F.col("g_at") / width)).alias("bin"))
    near = t.join(g, ["pair_id", "level", "bin"]).filter((F.col("n") <= 1) | (F.abs(F.col("at") - F.col("g_at")) < width)).select("pair_id", "t_seq", "g_seq")
    # by shared words and contained titles
    tokens = _tokens(features(chapters), pairs.select(F.col("template_doc_id").alias("doc_id")).distinct(), spare, least, cfg)
    mine = with_template(asked, tokens.select("doc_id", F.col("seq").alias("t_seq"), F.col("level").alias("t_level"), F.col("kind"), F.col("token")))
    other = tokens.select(F.col("doc_id").alias("target_doc_id"), F.col("seq").alias("g_seq"), F.col("level").alias("g_level"), F.translate("kind", "<>", "><").alias("kind"), "token")
    apart = F.abs(F.col("t_level") - F.col("g_level"))
    fits = F.when(F.col("kind").isin("s", "c"), apart == 0).when(F.col("kind") == "x", apart.between(1, 2)).otherwise(apart <= 2)
    shared = mine.join(other, ["target_doc_id", "kind", "token"]).filter(fits).select("pair_id", "t_seq", "g_seq")
    found = near.unionByName(shared)
    if isinstance(semantic, DataFrame):
        found = found.unionByName(semantic.select("pair_id", "t_seq", "g_seq").join(asked.select("pair_id"), "pair_id", "left_semi"))
    return found.distinct()


def _tokens(known: DataFrame, templates: DataFrame, spare: float, least: float, cfg: MappingConfig) -> DataFrame:
    """doc_id, seq, level, kind and token. Kinds: s and x words of titles for cells of one and of two levels, c words of contents,
    < what a title is looked for by inside others, > what it is found by."""
    often = known.join(templates, "doc_id", "left_semi").select(F.explode(F.array_union("words", "title_words")).alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    clean, whole = F.col("clean"), F.lit(1 << 30)
    pieces = lambda n: F.when(F.length(clean) >= n, F.transform(F.sequence(F.lit(1), F.length(clean) - n + 1), lambda i: F.substring(clean, i, n))).otherwise(F.array().cast("array<string>"))

    def of(kind: str, tokens: Column, most: Column = whole) -> Column:
        return F.transform(tokens, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token"), most.cast("int").alias("most")))

    def first(kind: str, words: str, share: float) -> Column:
        return of(kind, F.col(words), F.size(words) - F.ceil(F.size(words) * F.lit(min(1.0, share) - EPS)) + 1)

    around = F.array_union(F.array_union(pieces(2), pieces(1)), F.array(F.lit("")))
    tokens = F.concat(
        first("s", "title_words", spare / (2 * cfg.title_weight)), first("x", "title_words", least), first("c", "words", spare / (2 * cfg.content_weight)),
        of("<", F.array(F.xxhash64(F.substring(clean, 1, 2)))), of(">", _hashes(around)),
    )
    rows = known.select("doc_id", "seq", "level", F.explode(tokens).alias("x")).select("doc_id", "seq", "level", "x.*").join(often, "token", "left")
    rank = F.row_number().over(Window.partitionBy("doc_id", "seq", "kind").orderBy(F.coalesce("often", F.lit(0)), "token"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= F.col("most")).select("doc_id", "seq", "level", "kind", "token")
