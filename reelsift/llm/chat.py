"""Multi-party perspective rotation of dialogues (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, system: str = "system", block: int = 256) -> DataFrame:
    """For every participant, the dialogue with that speaker as assistant and the others as named users.

    One row per dialogue, ``speaker`` and turn: conv_id, speaker, turn, role (assistant, user or system as rendered), segment
    (its text in the rendered dialogue), start (characters before it), mask_start and mask_end (the characters of the rendered
    dialogue that are trained on: what the speaker says with its end mark; both null where nothing is). The segments of a
    conv_id and speaker in the order of start are the rendered dialogue. Turns of ``system`` stay what they are and are no
    participant's.

    Turns come in order of turn (null first), role and text. A null role is a user without a name, and no participant's; a
    dialogue without participants gives no rows. A null text is an empty one. Marks inside a text are broken by a space.
    Rows that repeat a turn are turns each. A null conv_id is a dialogue of its own. An empty table gives an empty result;
    other columns are ignored.

    Starts are sums within blocks of ``block`` turn numbers and over the blocks, so that a long dialogue is not one window.
    """
    rows = turns.select(F.struct(F.col("conv_id").isNull().alias("no"), F.col("conv_id").alias("id")).alias("c"), "turn", F.col("role").alias("by"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    speakers = rows.where(F.col("by").isNotNull() & (F.col("by") != system)).select("c", F.col("by").alias("speaker")).distinct()
    said = F.col("by") == F.col("speaker")
    role = F.when(said, "assistant").when(F.col("by") == system, "system").otherwise("user")
    header = F.concat(F.lit(BEGIN), "role", F.when((F.col("role") == "user") & F.col("by").isNotNull(), F.concat(F.lit(" name="), F.replace("by", F.lit("<|"), F.lit("< |")))).otherwise(""), F.lit("\n"))
    out = rows.join(speakers, "c").withColumn("role", F.coalesce(role, F.lit("user"))).withColumn("header", header)
    out = out.withColumn("segment", F.concat("header", "text", F.lit(END + "\n"))).withColumn("n", F.length("segment").cast("long"))
    out = out.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block))
    key = ["c", "speaker", "block"]
    over_blocks = Window.partitionBy("c", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = out.groupBy(*key).agg(F.sum("n").alias("all")).select(*key, (F.sum("all").over(over_blocks) - F.col("all")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy(*key).orderBy("turn", "by", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    out = out.withColumn("inside", inside).join(before, key).withColumn("start", F.col("before") + F.col("inside"))
    begin = F.col("start") + F.length("header")
    mine = F.col("role") == "assistant"
    return out.select(F.col("c.id").alias("conv_id"), "speaker", "turn", "role", "segment", "start", F.when(mine, begin).alias("mask_start"), F.when(mine, begin + F.length("text") + len(END)).alias("mask_end"))


ROTATE_SQL = f"""
WITH r AS (SELECT conv_id, turn, role AS who, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM r WHERE who <> 'system'),
h AS (SELECT r.conv_id, speaker, turn, who, text,
    CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user' END AS role
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
g AS (SELECT *, '{BEGIN}' || role || CASE WHEN role = 'user' AND who IS NOT NULL THEN ' name=' || replace(who, '<|', '< |') ELSE '' END || chr(10) AS header FROM h),
s AS (SELECT *, header || text || '{END}' || chr(10) AS segment FROM g),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who NULLS FIRST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT conv_id, speaker, turn, role, segment, start,
  CASE WHEN role = 'assistant' THEN start + length(header) END AS mask_start,
  CASE WHEN role = 'assistant' THEN start + length(header) + length(text) + {len(END)} END AS mask_end FROM o
"""
