"""One-to-one mapping of template chapters to target chapters, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators import similarity as S

SIMS = ["title_sim", "content_sim", "position_sim", "structure_sim"]
PICKED = "pair_id long, t_seq int, g_seq int, crossed boolean, score double, title_sim double, content_sim double, position_sim double, structure_sim double"


class Greedy:
    """The choices of one pair. Template chapters come by level, then in order; ``held`` is the number of targets per level."""

    def __init__(self, held: dict[int, int], cfg: S.MappingConfig):
        self.free, self.used, self.cfg = dict(held), set(), cfg

    def choose(self, level: int, overall: list[float], levels: list[int], seqs: list[int]) -> tuple[int, bool]:
        """(place of the choice or -1, crossed) among candidates that come by falling score, then by seq.

        The best free target of the same level wins, the first on ties; if none reaches the threshold, targets of the next
        levels up and down (two away if those have none free), at a higher one."""
        for k, score in enumerate(overall):
            if score < self.cfg.similarity:
                break
            if levels[k] == level and seqs[k] not in self.used:
                return self._take(k, levels, seqs), False
        near = [x for x in (level - 1, level + 1) if self.free.get(x, 0) > 0] or [x for x in (level - 2, level + 2) if x > 0]
        best = -1
        for k, score in enumerate(overall):
            if score < self.cfg.semantic or best >= 0 and score < overall[best]:
                break
            if levels[k] in near and seqs[k] not in self.used and (best < 0 or levels[k] < levels[best]):
                best = k
        return (self._take(best, levels, seqs), True) if best >= 0 else (-1, False)

    def _take(self, k: int, levels: list[int], seqs: list[int]) -> int:
        self.used.add(seqs[k])
        self.free[levels[k]] -= 1
        return k


_KEY = ["pair_id", "kind", "t_level", "t_seq"]


def _changes(b: pa.RecordBatch) -> np.ndarray:
    """Where a row's key differs from that of the row before; a level that is null differs from all."""
    keys = [b.column(c).to_numpy(zero_copy_only=False) for c in _KEY]
    return np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))) if b.num_rows else np.zeros(0, bool)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, cut anew so that rows of one key stay together; only the last key's rows wait."""
    wait: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(wait).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        cut = int(np.flatnonzero(_changes(b))[-1])
        if cut:
            wait.append(b.slice(0, cut))
            yield joined()
            wait = []
        elif wait and any(wait[-1].column(c)[-1] != b.column(c)[0] for c in _KEY):
            yield joined()
            wait = []
        wait.append(b.slice(cut))
    if wait:
        yield joined()


def map_chapters(pairs: DataFrame, chapters: DataFrame, scores: DataFrame, cfg: S.MappingConfig = S.CONFIG) -> DataFrame:
    """mappings: pair_id, t_seq, g_seq (null if none), match_type, confidence, confidence_level and the similarities.

    scores: rows of pair_scores or strong_scores. Each choice depends on the ones before it, so a pair's rows go one after the other
    through sorted partitions: first how many targets each level has, then each template chapter, followed by the scores that can win,
    the best first. Of a pair only the used targets are kept, and of the scores those of one template chapter."""
    none = {c: F.lit(None).cast("double").alias(c) for c in ("o", *SIMS)}
    known = [F.col(c).cast("int").alias(c) for c in ("t_level", "t_seq", "g_level", "g_seq")]
    cands = scores.filter(S.is_strong(cfg)).select("pair_id", F.lit(1).alias("kind"), *known, (-F.col("overall")).alias("o"), *SIMS)
    held = chapters.filter("level is not null").groupBy(F.col("doc_id").alias("target_doc_id"), F.col("level").cast("int").alias("g_level")).agg(F.count("*").cast("int").alias("g_seq"))
    held = pairs.select("pair_id", "target_doc_id").join(held, "target_doc_id").select("pair_id", F.lit(0).alias("kind"), F.lit(0).alias("t_level"), F.lit(0).alias("t_seq"), "g_level", "g_seq", *none.values())
    asked = S.with_template(pairs.select("pair_id", "template_doc_id", "target_doc_id"), chapters.select("doc_id", F.col("seq").alias("t_seq"), F.col("level").alias("t_level")))
    asked = asked.withColumns({"g_level": F.lit(None), "g_seq": F.lit(None)}).select("pair_id", F.lit(1).alias("kind"), *known, *none.values())
    rows = held.unionByName(asked).unionByName(cands).repartition("pair_id").sortWithinPartitions(*_KEY, F.asc_nulls_first("o"), "g_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, pair_of, held = None, None, {}
        for b in _whole_groups(batches):
            col = {n: b.column(n) for n in b.schema.names}
            owner, g_level, g_seq = (pc.fill_null(col[n], 0).to_numpy().tolist() for n in ("pair_id", "g_level", "g_seq"))
            is_held = col["kind"].to_numpy() == 0
            is_asked = ~is_held & col["o"].is_null().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(is_held).tolist():
                held.setdefault(owner[i], {})[g_level[i]] = g_seq[i]
            at, fresh = np.flatnonzero(is_asked), _changes(b)
            stops = np.append(np.flatnonzero(fresh | is_asked), b.num_rows)
            first, last = at + 1, stops[np.searchsorted(stops, at, "right")]
            for j in np.flatnonzero((at[1:] == at[:-1] + 1) & ~fresh[at[1:]])[::-1]:  # a chapter that is there twice: its scores follow the last
                first[j], last[j] = first[j + 1], last[j + 1]
            overall = (-col["o"].to_numpy(zero_copy_only=False)).tolist()
            where, crossed = [], []
            for i, level, x, y in zip(at.tolist(), col["t_level"].take(pa.array(at)).to_numpy(zero_copy_only=False).tolist(), first.tolist(), last.tolist(), strict=True):
                if pair is None or owner[i] != pair_of:
                    pair, pair_of = Greedy(held.get(owner[i], {}), cfg), owner[i]
                k, far = pair.choose(level, overall[x:y], g_level[x:y], g_seq[x:y]) if x < y else (-1, False)
                where.append(x + k if k >= 0 else None)
                crossed.append(far)
            held = {owner[-1]: held.get(owner[-1], {})}
            which, at = pa.array(where, pa.int64()), pa.array(at)
            columns = [col["pair_id"].take(at), col["t_seq"].take(at), col["g_seq"].take(which), pa.array(crossed, pa.bool_()), pc.negate(col["o"].take(which)), *[col[n].take(which) for n in SIMS]]
            yield pa.RecordBatch.from_arrays(columns, ["pair_id", "t_seq", "g_seq", "crossed", "score", *SIMS])

    chosen = rows.mapInArrow(run, PICKED)
    own = F.coalesce(S.confidence(*map(F.col, SIMS)), F.lit(0.0))
    kind = F.when(F.col("g_seq").isNull(), "none").when(F.col("crossed"), "semantic").otherwise(S.match_type(F.col("score"), F.col("title_sim"), F.col("position_sim"), cfg))
    return chosen.select("pair_id", "t_seq", "g_seq", kind.alias("match_type"), own.alias("confidence"), S.confidence_level(own).alias("confidence_level"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SIMS])


def enhance_mappings(mappings: DataFrame, candidates: DataFrame, chapters_t: DataFrame, chapters_g: DataFrame, least: float = 0.4) -> DataFrame:
    """Gives unmatched chapters the best candidate (pair_id, t_seq, g_seq, score) within one level; confidence stays 0.

    chapters_t, chapters_g: pair_id, seq and level of both sides."""
    t = chapters_t.select("pair_id", F.col("seq").alias("t_seq"), F.col("level").alias("t_level"))
    g = chapters_g.select("pair_id", F.col("seq").alias("g_seq"), F.col("level").alias("g_level"))
    near = candidates.join(t, ["pair_id", "t_seq"]).join(g, ["pair_id", "g_seq"]).filter((F.abs(F.col("t_level") - F.col("g_level")) <= 1) & (F.col("score") >= least))
    first = F.row_number().over(Window.partitionBy("pair_id", "t_seq").orderBy(F.desc("score"), "g_seq"))
    best = near.withColumn("_n", first).filter("_n = 1").select("pair_id", "t_seq", F.col("g_seq").alias("_g"))
    joined = mappings.join(best, ["pair_id", "t_seq"], "left")
    taken = F.col("g_seq").isNull() & F.col("_g").isNotNull()
    return joined.withColumn("match_type", F.when(taken, "semantic").otherwise(F.col("match_type"))).withColumn("g_seq", F.coalesce("g_seq", "_g")).drop("_g")


def unmapped_targets(pairs: DataFrame, chapters: DataFrame, mappings: DataFrame) -> DataFrame:
    rows = pairs.join(chapters.select(F.col("doc_id").alias("target_doc_id"), F.col("seq").alias("g_seq"), "title", "level"), "target_doc_id")
    return rows.join(mappings.filter("g_seq is not null").select("pair_id", "g_seq"), ["pair_id", "g_seq"], "left_anti").select("pair_id", "g_seq", "title", "level")


def mapping_summary(mappings: DataFrame, pairs: DataFrame | None = None, chapters: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """Per pair: total, count per type, mean confidence, successes, failures, rate and confidence histogram.

    With pairs and chapters also n_targets, the mappings and the targets that none of them has; with merged renumbering
    patterns their number."""
    kinds = [F.count_if(F.col("match_type") == k).alias(f"n_{k}") for k in ("exact", "similar", "semantic", "positional", "none")]
    hit = F.count_if(F.col("g_seq").isNotNull())
    found = mappings.groupBy("pair_id").agg(
        F.count("*").alias("total"), *kinds, F.avg("confidence").alias("overall_confidence"), hit.alias("n_mapped"), (F.count("*") - hit).alias("n_failed"), (hit / F.count("*")).alias("mapping_rate"),
        *[F.count_if(F.col("confidence_level") == k).alias(f"n_{k}") for k in ("high", "medium", "low")], F.count_distinct("g_seq").alias("_used"),
    )
    if pairs is not None and chapters is not None:
        per_doc = chapters.groupBy(F.col("doc_id").alias("target_doc_id")).agg(F.count("*").alias("_n"))
        sizes = pairs.select("pair_id", "target_doc_id").join(per_doc, "target_doc_id").drop("target_doc_id")
        found = found.join(sizes, "pair_id", "left").withColumn("n_targets", F.col("total") + F.coalesce("_n", F.lit(0)) - F.col("_used")).drop("_n")
    if patterns is not None:
        found = found.join(patterns.groupBy("pair_id").agg(F.count("*").alias("n_patterns")), "pair_id", "left").fillna(0, ["n_patterns"])
    return found.drop("_used")


def mapping_details(pairs: DataFrame, chapters: DataFrame, mappings: DataFrame) -> DataFrame:
    t = chapters.select(F.col("doc_id").alias("template_doc_id"), F.col("seq").alias("t_seq"), F.col("title").alias("t_title"), F.col("level").alias("t_level"))
    g = chapters.select(F.col("doc_id").alias("target_doc_id"), F.col("seq").alias("g_seq"), F.col("title").alias("g_title"), F.col("level").alias("g_level"))
    titles = S.with_template(pairs.select("pair_id", "template_doc_id", "target_doc_id"), t.withColumnRenamed("template_doc_id", "doc_id"))
    rows = mappings.join(titles, ["pair_id", "t_seq"]).join(g, ["target_doc_id", "g_seq"], "left")
    return rows.drop("template_doc_id", "target_doc_id")


def missing_chapters(mappings: DataFrame) -> DataFrame:
    """Template chapters of type none, without target or without confidence."""
    return mappings.filter(is_missing()).select("pair_id", "t_seq", "match_type")


def is_missing() -> Column:
    return (F.col("match_type") == "none") | F.col("g_seq").isNull() | (F.col("confidence") == 0)
