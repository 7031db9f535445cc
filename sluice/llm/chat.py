"""Chat formatting by rotating the perspective.

For every participant of a dialogue (a role that speaks in it) the whole dialogue
is rendered once with that participant as the assistant and everyone else as a
user of that name.  A rendering is returned turn by turn, each turn with its text,
its place in the rendering in characters, and its mask: the span of characters
that the assistant says, which is what a model learns from.  Renderings are thus
never gathered in one row, and a dialogue of any length is spread over tasks:
places are prefix sums in two levels, over runs of turns and within each run.

Markers in texts and roles, and line breaks in roles, are escaped (``<|`` becomes ``<\\|``), so no text can forge a turn.

Defined results: a null role speaks as ``<|none|>``, a name that no role can have; a null text is empty; turns come by
number, nulls first, ties by role, then text, and rows that repeat a turn are
turns of their own; null conversation ids are one dialogue; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
NOBODY = "<|none|>"
#: Turn numbers in a run.
RUN = 64


def escaped(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit("<|"), F.lit("<\\|"))


def speaker_turns(talk: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    return talk.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.replace(escaped(F.col(role)), F.lit("\n"), F.lit("\\n")), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(escaped(F.col(text)), F.lit("")).alias("text"),
    )


def perspectives(talk: DataFrame, **columns) -> DataFrame:
    """``conv_id, participant, turn, speaker, place, start, rendered, mask_start, mask_end``."""
    turns = speaker_turns(talk, **columns)
    who = cut(turns.select("conv_id", "speaker").distinct()).withColumnRenamed("speaker", "participant")
    same = turns["conv_id"].eqNullSafe(who["conv_id"])
    told = turns.join(who, same).select(turns["conv_id"], "participant", "turn", "speaker", "text")
    mine = F.col("speaker") == F.col("participant")
    head = F.when(mine, F.lit(f"{BEGIN}assistant\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), "speaker", F.lit("\n")))
    # The head's characters and the rendering's, counted without building it.
    told = (
        told.withColumn("head", F.length(head).cast("long"))
        .withColumn("size", (F.col("head") + F.length("text") + len(END)).cast("long"))
        .withColumn("rendered", F.concat(head, "text", F.lit(END)))
        .withColumn("run", F.floor(F.col("turn") / RUN))
    )
    view = ("conv_id", "participant")
    earlier = Window.partitionBy(*view).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = told.groupBy(*view, "run").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    offsets = runs.select(*view, "run", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns"))
    within = Window.partitionBy(*view, "run").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    number = Window.partitionBy(*view, "run").orderBy("turn", "speaker", "text")
    local = told.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("n", F.row_number().over(number) - 1)
    a, b = local.alias("a"), offsets.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.participant") == F.col("b.participant")) & F.col("a.run").eqNullSafe(F.col("b.run"))
    start = F.col("a.before") + F.col("b.chars")
    mask = F.col("a.speaker") == F.col("a.participant")
    return a.join(b, same).select(
        "a.conv_id",
        "a.participant",
        "a.turn",
        "a.speaker",
        (F.col("a.n") + F.col("b.turns")).cast("long").alias("place"),
        start.cast("long").alias("start"),
        "a.rendered",
        F.when(mask, start + F.col("a.head")).cast("long").alias("mask_start"),
        F.when(mask, start + F.col("a.size") - 1).cast("long").alias("mask_end"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(replace(replace(role, '<|', '<\|'), chr(10), '\n'), '<|none|>') AS speaker, coalesce(replace(text, '<|', '<\|'), '') AS text
  FROM conversations
), w AS (SELECT DISTINCT conv_id, speaker AS participant FROM t),
r AS (
  SELECT t.conv_id, w.participant, t.turn, t.speaker, t.text,
         CASE WHEN t.speaker = w.participant THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || t.speaker || chr(10) END AS head
  FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id
), p AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM r
), s AS (
  SELECT *, (row_number() OVER o - 1)::BIGINT AS place,
         (coalesce(sum(length(rendered)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM p WINDOW o AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, participant, turn, speaker, place, start, rendered,
       CASE WHEN speaker = participant THEN (start + length(head))::BIGINT END AS mask_start,
       CASE WHEN speaker = participant THEN (start + length(rendered) - 1)::BIGINT END AS mask_end
FROM s
"""
