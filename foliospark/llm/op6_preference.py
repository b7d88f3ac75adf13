"""Preference formatting, with DataFrame functions only: shared turns become one prompt, the rest two masked completions.

Input rows are turns of chosen and rejected conversations: (pair_id, side, turn, role, text), side `chosen` or
`rejected`. Turns are matched by their place: the turn number, and among rows of one number the order of role and text.
The prompt is the longest run of first turns that both sides have alike (role and text, null like null). Output is one
row per rendered turn, so a conversation of any length is spread over tasks: `part` is prompt (once for both sides),
chosen or rejected; `rendered` is the turn in the chat template; `trained` is true for assistant turns of a completion
and false (masked) elsewhere. `assemble` joins a pair's turns into three strings for conversations known to be short.

A null turn number comes before all others; a null role is rendered as `user`, a null text as empty. A null pair_id is a pair of
its own. Exact repeats of a row count once. A pair with one side only has no prompt. Extra columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SIDES = ("chosen", "rejected")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def preference_turns(turns: DataFrame) -> DataFrame:
    """One row per rendered turn: pair_id, part, turn, seq, role, rendered, trained."""
    rows = turns.select("pair_id", "side", "turn", "role", "text").filter(F.col("side").isin(*SIDES)).distinct()
    same_place = Window.partitionBy("pair_id", "side", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("seq", F.row_number().over(same_place) - 1)
    turn = lambda side: F.first(F.when(F.col("side") == side, F.struct("role", "text")), ignorenulls=True).alias(side)
    places = rows.groupBy("pair_id", "turn", "seq").agg(*[turn(s) for s in SIDES])
    chosen, rejected = (F.col(s) for s in SIDES)
    alike = F.coalesce(chosen["role"].eqNullSafe(rejected["role"]) & chosen["text"].eqNullSafe(rejected["text"]) & chosen.isNotNull() & rejected.isNotNull(), F.lit(False))
    places = places.withColumn("alike", alike)
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "seq")
    splits = places.groupBy(F.col("pair_id").alias("its_pair")).agg(F.min(F.when(~F.col("alike"), place)).alias("split"))
    joined = places.join(splits, F.col("pair_id").eqNullSafe(F.col("its_pair")))
    shared = F.col("split").isNull() | (place < F.col("split"))
    part = lambda name, turn, when: F.when(when & turn.isNotNull(), F.struct(F.lit(name).alias("part"), turn["role"].alias("role"), turn["text"].alias("text")))
    parts = F.array_compact(F.array(part("prompt", chosen, shared), part("chosen", chosen, ~shared), part("rejected", rejected, ~shared)))
    out = joined.select("pair_id", "turn", "seq", F.explode(parts).alias("p")).select("pair_id", "p.part", "turn", "seq", "p.role", "p.text")
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    return out.select("pair_id", "part", "turn", F.col("seq").cast("int").alias("seq"), "role", rendered(F.col("role"), F.col("text")).alias("rendered"), trained.alias("trained"))


def assemble(rows: DataFrame) -> DataFrame:
    """One row per pair with prompt, chosen and rejected strings; gathers a pair's turns, so for short conversations only."""
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "seq", "rendered")
    gathered = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == name, order))), lambda x: x["rendered"]), "").alias(name)
    return rows.groupBy("pair_id").agg(*[gathered(x) for x in ("prompt", *SIDES)])


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Chosen: a conversation up to its last assistant turn. Rejected: the same with that reply taken from the conversation
    of the next id (nothing in its place if that has none). Conversations without a reply make no pair.
    Rows of a null conv_id or a null turn are dropped, as in the SQL: they have no next conversation and no place before a reply."""
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null")
    replies = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", "last.turn", "last.text")
    last = replies.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("last_turn"))
    own = turns.withColumnRenamed("conv_id", "pair_id").join(last, "pair_id").filter("turn <= last_turn")
    chosen = own.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    before = own.filter("turn < last_turn").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    other = replies.select((F.col("conv_id") - 1).alias("pair_id"), "text")
    swapped = last.join(other, "pair_id").select("pair_id", F.lit("rejected").alias("side"), F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    return chosen.unionByName(before).unionByName(swapped)


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_turns(reply_pairs(conversations)).drop("role")


SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
replies AS (
  SELECT conv_id, turn, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) AS k FROM turns WHERE role = 'assistant'
  ) WHERE k = 1
),
sides AS (
  SELECT t.conv_id AS pair_id, 'chosen' AS side, t.turn, t.role, t.text FROM turns t JOIN replies r USING (conv_id) WHERE t.turn <= r.turn
  UNION ALL
  SELECT t.conv_id, 'rejected', t.turn, t.role, t.text FROM turns t JOIN replies r USING (conv_id) WHERE t.turn < r.turn
  UNION ALL
  SELECT r.conv_id, 'rejected', r.turn, 'assistant', n.text FROM replies r JOIN replies n ON n.conv_id = r.conv_id + 1
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role NULLS FIRST, text NULLS FIRST) - 1 AS seq FROM (SELECT DISTINCT * FROM sides)
),
chosen AS (SELECT * FROM placed WHERE side = 'chosen'),
rejected AS (SELECT * FROM placed WHERE side = 'rejected'),
matched AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.seq, r.seq) AS seq,
         c.side IS NOT NULL AND r.side IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS alike
  FROM chosen c FULL JOIN rejected r ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.seq = r.seq
),
marked AS (
  SELECT pair_id, turn, seq, bool_and(alike) OVER (PARTITION BY pair_id ORDER BY turn, seq ROWS UNBOUNDED PRECEDING) AS shared FROM matched
),
parts AS (
  SELECT p.pair_id, CASE WHEN m.shared THEN 'prompt' ELSE p.side END AS part, p.turn, p.seq, p.role, p.text
  FROM placed p JOIN marked m USING (pair_id, turn, seq) WHERE NOT (m.shared AND p.side = 'rejected')
)
SELECT pair_id, part, turn, CAST(seq AS INTEGER) AS seq,
       '{OPEN}' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered,
       part <> 'prompt' AND coalesce(role = 'assistant', false) AS trained
FROM parts
"""
