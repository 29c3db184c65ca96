"""Chat dialogues rendered once from the view of every participant.

For each conversation and each speaker in it, the speaker's turns become the assistant's, all other speakers
become named users, system turns stay the system's, and the mask lists the character ranges of the speaker's
own words (with their end mark), which are the ones to train on.

A dialogue is rendered in parts of at most `part_turns` consecutive turn numbers, so that no task ever holds a
whole conversation of unbounded length; `offset` is where a part starts in the whole dialogue, which is its
parts in order. Ordinary conversations are one part. Mask ranges count from the start of their part.

Turns go by turn, then role, then text; repeated turns are rendered repeatedly. A null turn number goes to a
last part of its own. A null text is empty, a null or empty role is the speaker `unknown`. A null conv_id is one
conversation. A conversation of system turns alone has no perspective and gives no row. Only DataFrame
functions are used. Extra columns are ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

PART_TURNS = 1000
LAST_PART = (1 << 62) - 1
SYSTEM = "system"
OPEN, CLOSE = "<|start|>", "<|end|>\n"


def _header():
    role, view = F.col("role"), F.col("perspective")
    return F.when(role == SYSTEM, F.lit(f"{OPEN}{SYSTEM}\n")).when(role == view, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), role, F.lit("\n")))


def rotate(conversations, part_turns=PART_TURNS):
    """One row per conversation, perspective and part: offset, n_turns, text, mask (array of start, end)."""
    turns = conversations.select(
        # a key without nulls joins as it is placed
        F.col("conv_id").isNull().alias("nameless"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(LAST_PART)).alias("part"),
        "turn",
        F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("said"),
    )
    views = turns.where(F.col("role") != SYSTEM).select("nameless", "conv", F.col("role").alias("perspective")).distinct()
    seen = turns.join(views, ["nameless", "conv"])
    header = _header()
    view = ["nameless", "conv", "perspective"]
    key = [*view, "part"]
    segment = F.concat(header, "said", F.lit(CLOSE))
    order = [F.col("turn").asc_nulls_last(), "role", "said"]
    window = Window.partitionBy(*key).orderBy(*order)
    placed = seen.select(
        *key,
        F.row_number().over(window).alias("nth"),
        segment.alias("segment"),
        F.sum(F.length(segment)).over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.length(header).alias("head"),
        F.length(segment).alias("size"),
        (F.col("role") == F.col("perspective")).alias("own"),
    )
    turn = F.struct("nth", "segment", (F.col("end") - F.col("size") + F.col("head")).alias("start"), "end", "own")
    parts = placed.groupBy(*key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # where a part starts comes from sizes alone: no rendered text passes through a conversation's window
    sizes = seen.groupBy(*key).agg(F.sum(F.length(header) + F.length("said") + F.lit(len(CLOSE))).alias("n_chars"))
    before = Window.partitionBy(*view).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("offset"))
    spans = F.transform(F.filter("turns", lambda t: t["own"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return parts.join(offsets, key).select(
        F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"),
        "perspective",
        "part",
        "offset",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
        spans.alias("mask"),
    )


#: The query's rows in DuckDB SQL, over the whole table.
SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(CAST(floor(turn / {PART_TURNS}.0) AS BIGINT), {LAST_PART}) AS part, turn,
         coalesce(nullif(role, ''), 'unknown') AS role, coalesce(text, '') AS said
  FROM conversations
), views AS (
  SELECT DISTINCT conv_id AS view_of, role AS perspective FROM turns WHERE role <> '{SYSTEM}'
), seen AS (
  SELECT *, CASE WHEN role = '{SYSTEM}' THEN '{OPEN}{SYSTEM}' WHEN role = perspective THEN '{OPEN}assistant'
                 ELSE '{OPEN}user name=' || role END || chr(10) AS head
  FROM turns JOIN views ON conv_id IS NOT DISTINCT FROM view_of
), placed AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS segment,
         row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS LAST, role, said) AS nth
  FROM seen
), ended AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY nth) AS stop FROM placed
), parts AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(segment, '' ORDER BY nth) AS text,
         coalesce(string_agg((stop - length(segment) + length(head))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY nth)
                  FILTER (WHERE role = perspective), '') AS mask
  FROM ended GROUP BY ALL
)
SELECT conv_id, perspective, part,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       n_turns, text, mask
FROM parts
"""
