"""Chat formatting: every participant's view of a dialogue.

For each speaker of a conversation the whole dialogue is rendered with that speaker as ``assistant`` and the others as
named users; the spans of the speaker's own messages (text and end marker) are the ones to train on. Speakers named
``system`` set the scene: they are rendered as system messages in every view and get no view of their own.

Messages follow turn, then role, then the hash of their text, then the text, nulls first. A conversation of any length is cut
into chunks of ``most`` messages in that order, so no task gathers one whole: a view's chunks, one after the other, are the
view. A message's place is the sum of three counts: of the ``block`` turn numbers before its own, of the turns, roles and
parts of the hash range before its own among them, and of what is left before it; so no sort takes a whole conversation, and
copies of a message are counted before they are placed. DataFrame functions only.

Defined results: rows that repeat a message exactly are each rendered; a null text is an empty one; a null role is a user
without a name and no participant; a null conv_id is a conversation of its own; markers inside texts or names are broken up
by a space; a conversation of system messages alone has no view; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import pick

BLOCK = 64
MOST = 256
SALTS = 16
START, END = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(START), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))


def _name(role: Column) -> Column:
    return F.regexp_replace(_clean(role), r"[\r\n]", " ")


def _hash(role: Column, text: Column) -> Column:
    """The same 32 bits in any SQL engine."""
    joined = F.concat(F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def _before(rows: DataFrame, keys: list[str], *order: Column | str) -> Column:
    """Sum of n over the rows of the same keys before this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))


def _joined(rows: DataFrame, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with a column of counts, by keys that may be null."""
    other = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], value)
    return rows.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*[f"_{k}" for k in keys])


def chunks(turns: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """conv_id, chunk and msgs, the ``most`` messages at places from chunk * most on, in order."""
    rows = pick(turns, conv_id="long", turn="long", role="string", text="string")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("h", _hash(F.col("role"), F.col("text")))
    rows = rows.withColumns({"block": F.floor(F.col("turn") / block), "part": F.shiftright("h", 24)})
    fine, coarse = ["conv_id", "block", "turn", "role", "part"], ["conv_id", "block"]
    per_part = rows.groupBy(*fine).agg(F.sum("n").alias("n"))
    per_block = per_part.groupBy(*coarse).agg(F.sum("n").alias("n"))
    per_block = per_block.withColumn("start", _before(per_block, ["conv_id"], F.asc_nulls_first("block")))
    per_part = per_part.withColumn("inside", _before(per_part, coarse, F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "part"))
    per_part = _joined(per_part, per_block, coarse, "start").withColumn("start", F.col("start") + F.col("inside"))
    rows = rows.withColumn("inside", _before(rows, fine, "h", F.asc_nulls_first("text")))
    rows = _joined(rows, per_part, fine, "start").withColumn("at", F.col("start") + F.col("inside"))
    floor = lambda x: F.floor(x / most)
    rows = rows.withColumn("chunk", F.explode(F.sequence(floor(F.col("at")), floor(F.col("at") + F.col("n") - 1))))
    first = F.greatest(F.col("at"), F.col("chunk") * most)
    here = F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * most) - first
    grouped = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct(first.alias("at"), "role", "text", here.alias("n")))).alias("msgs"))
    copied = F.flatten(F.transform("msgs", lambda m: F.array_repeat(F.struct(m["role"].alias("role"), m["text"].alias("text")), m["n"].cast("int"))))
    return grouped.withColumn("msgs", copied)


def perspectives(turns: DataFrame, block: int = BLOCK, most: int = MOST, salts: int = SALTS) -> DataFrame:
    """A row per conversation, participant and chunk: text, and trained, the character spans (end exclusive) of the participant's
    turns. Chunks of a conversation are dealt to ``salts`` parts, each of which gets its participants."""
    pieces = chunks(turns, block, most).withColumn("salt", (F.col("chunk") % salts).cast("int"))
    people = pick(turns, conv_id="long", role="string").filter("role is not null and role <> 'system'").distinct()
    people = people.select(F.col("conv_id").alias("c"), F.col("role").alias("participant"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    rows = pieces.join(people, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("salt") == F.col("s"))).drop("c", "s", "salt")

    def parts(m: Column) -> Column:
        own = m["role"] == F.col("participant")
        head = F.when(own, "assistant").when(m["role"].isNull(), "user").when(m["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), _name(m["role"])))
        return F.struct(F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(_clean(m["text"]), F.lit(END)).alias("body"), F.coalesce(own, F.lit(False)).alias("own"))

    rows = rows.withColumn("parts", F.transform("msgs", parts))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + 1
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda n, p: n + size(p))
    spans = F.transform("parts", lambda p, i: F.struct((before(i) + F.length(p["head"])).alias("start"), (before(i) + F.length(p["head"]) + F.length(p["body"])).alias("end"), p["own"].alias("own")))
    spans = F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(s["start"], s["end"]))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return rows.select("conv_id", "participant", "chunk", F.size("msgs").alias("n_messages"), text.alias("text"), spans.alias("trained"))


def digest(found: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("trained", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("conv_id", "participant", "chunk", F.col("n_messages").cast("long").alias("n_messages"), "text", F.size("trained").cast("long").alias("n_trained"), spans.alias("trained"))


ORACLE_SQL = f"""
WITH g AS (SELECT *, CAST(('0x' || substr(md5(coalesce(role, '') || chr(10) || coalesce(text, '')), 1, 8)) AS BIGINT) AS h FROM conversations),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, h, text NULLS FIRST) - 1 AS place FROM g),
p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
s AS (
  SELECT m.conv_id, participant, place // {MOST} AS chunk, place, coalesce(role = participant, false) AS own,
    '{START}' || CASE WHEN role = participant THEN 'assistant' WHEN role IS NULL THEN 'user' WHEN role = 'system' THEN 'system'
      ELSE 'user name=' || regexp_replace(replace(replace(role, '{START}', '< |im_start|>'), '{END}', '< |im_end|>'), '[\\r\\n]', ' ', 'g') END || chr(10) AS head,
    replace(replace(coalesce(text, ''), '{START}', '< |im_start|>'), '{END}', '< |im_end|>') || '{END}' AS body
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - (length(head) + length(body) + 1) AS pos FROM s
  WINDOW w AS (PARTITION BY conv_id, participant, chunk ORDER BY place ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, chunk, count(*) AS n_messages, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  count(*) FILTER (own) AS n_trained,
  coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (own), '') AS trained
FROM o GROUP BY ALL
"""
