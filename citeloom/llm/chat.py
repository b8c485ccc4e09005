"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a dialogue the dialogue is rendered once with that speaker as the assistant, the other speakers
as named users and context roles (system) as they are. The mask lists the character ranges of the assistant's words and
their end mark, which a loss would cover.

A dialogue comes in one row a participant. Inside, its turns are gathered in stretches of stretch_turns consecutive turn
numbers, rendered one by one and put together in order, so that no group grows with the length of a dialogue; only a
dialogue of more than part_chars characters comes in several rows: part numbers them, and the masks of all its parts count
from the dialogue's start, so that the parts joined make the whole rendering with its whole mask. Whether any dialogue has
more than one stretch is looked up first, by turn numbers alone.

Null text renders as empty, a null speaker as 'unknown'; turns that tie are ordered by speaker, then text, and repeated
rows are all rendered. Rows with a null turn come first. Rows with a null dialogue id belong to no dialogue and give
nothing, nor does a dialogue in which only context roles speak. Control marks inside a text are broken up ('<|' becomes '< |'). Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = ("system",), stretch_turns: int = 512, part_chars: int = 1 << 24) -> DataFrame:
    """One row per dialogue, participant and part (nearly always one): conv_id, perspective, part, n_turns, text, mask (array of start and stop)."""
    said = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.floor(F.col(turn_col) / F.lit(stretch_turns)).cast("long").alias("stretch"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("who"),
            F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
        ).alias("m"),
    )
    parts = said.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list("m")).alias("said"))
    speakers = parts.select("conv_id", F.explode(F.array_distinct(F.transform("said", lambda m: m["who"]))).alias("perspective"))
    speakers = speakers.where(~F.col("perspective").isin(*context_roles)).distinct() if context_roles else speakers.distinct()
    context = F.array(*[F.lit(r) for r in context_roles]) if context_roles else F.array().cast("array<string>")

    def rendered(m):
        own = m["who"] == F.col("perspective")
        head = (
            F.when(own, F.lit("<|im_start|>assistant\n"))
            .when(F.array_contains(context, m["who"]), F.concat(F.lit("<|im_start|>"), m["who"], F.lit("\n")))
            .otherwise(F.concat(F.lit("<|im_start|>user name="), m["who"], F.lit("\n")))
        )
        return F.struct(own.alias("own"), head.alias("head"), F.concat(m["body"], F.lit("<|im_end|>")).alias("tail"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("mask"))

    def step(state, x):
        begin = state["at"] + F.length(x["head"])
        stop = begin + F.length(x["tail"])
        span = F.array(F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop")))
        return F.struct((stop + 1).cast("long").alias("at"), F.when(x["own"], F.concat(state["mask"], span)).otherwise(state["mask"]).alias("mask"))

    shown = parts.join(speakers, "conv_id").select("conv_id", "perspective", "stretch", F.transform("said", rendered).alias("shown"))
    stretches = shown.select(
        "conv_id",
        "perspective",
        "stretch",
        F.size("shown").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("shown", lambda x: F.concat(x["head"], x["tail"], F.lit("\n")))).alias("text"),
        F.aggregate("shown", start, step, lambda s: s["mask"]).alias("mask"),
    )
    first = F.coalesce("stretch", F.lit(-(1 << 62)))
    broken = said.groupBy("conv_id").agg(F.min(first).alias("low"), F.max(first).alias("high")).where("low <> high").select("conv_id")
    as_whole = [F.lit(0).cast("long").alias("part"), "n_turns", "text", "mask"]
    if broken.isEmpty():  # a pass over the turn numbers; nearly always so
        return stretches.select("conv_id", "perspective", *as_whole)
    whole = stretches.join(broken, "conv_id", "left_anti").select("conv_id", "perspective", *as_whole)
    # stretches of longer dialogues: their places from their lengths alone, then together by part
    several = stretches.join(broken, "conv_id", "left_semi")
    before = F.sum("size").over(Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("stretch")).rowsBetween(Window.unboundedPreceding, -1))
    places = several.select("conv_id", "perspective", "stretch", F.length("text").cast("long").alias("size")).withColumn("at", F.coalesce(before, F.lit(0)))
    places = places.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"), "at")
    placed = several.join(places, (F.col("conv_id") == F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("stretch").eqNullSafe(F.col("s")))
    moved = F.transform("mask", lambda x: F.struct((x["start"] + F.col("at")).alias("start"), (x["stop"] + F.col("at")).alias("stop")))
    piece = F.struct("at", "n_turns", "text", moved.alias("mask"))
    joined = placed.groupBy("conv_id", "perspective", F.floor(F.col("at") / F.lit(part_chars)).cast("long").alias("part")).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))  # about part_chars characters
    long = joined.select(
        "conv_id",
        "perspective",
        "part",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["n_turns"]).alias("n_turns"),
        F.concat_ws("", F.col("pieces.text")).alias("text"),
        F.flatten(F.col("pieces.mask")).alias("mask"),
    )
    return whole.unionByName(long)


def op9_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderings with their masks as text start:stop, comma-joined."""
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.concat_ws(",", F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))))


OP9_SQL = """
WITH m AS (
  SELECT conv_id, turn, CAST(floor(turn / 512.0) AS BIGINT) AS stretch, coalesce(role, 'unknown') AS who,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM m WHERE who <> 'system'),
r AS (
  SELECT m.conv_id, p.perspective, m.stretch, m.turn, m.who, m.body, m.who = p.perspective AS own,
         CASE WHEN m.who = p.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN m.who = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || m.who || chr(10) END AS head,
         m.body || '<|im_end|>' AS tail
  FROM m JOIN p ON m.conv_id = p.conv_id),
o AS (
  SELECT *, sum(length(head) + length(tail) + 1) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS stop
  FROM r),
q AS (
  SELECT *, min(stop + 1 - length(head) - length(tail) - 1) OVER (PARTITION BY conv_id, perspective, stretch) // 16777216 AS part
  FROM o)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(head || tail || chr(10), '' ORDER BY turn NULLS FIRST, who, body) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(tail) AS BIGINT) || ':' || CAST(stop AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, who, body), '') AS mask
FROM q GROUP BY conv_id, perspective, part
"""
