"""Preference formatting: one prompt, two masked completions.

A pair is two conversations.  Their longest common prefix of turns (same role,
same text) is the prompt and is rendered once; what follows on each side is
that side's completion, in which only the turns of the assistant are trained on.
A turn is one row of the result: conversations are never gathered into one
value, so a conversation may be of any length.

The first differing turn of a pair is the least turn number at which the two
sides do not hold the same rows: a count and 128-bit digests per (pair, turn), then a
minimum per pair, both with partial aggregates.

``answers_swapped`` makes pairs that share turns from any table of conversations:
chosen is a conversation, rejected its turns up to the last answer of the trained
role with the last answer of its neighbour (2p and 2p + 1) in that place.

Defined cases: a conversation without a partner is all completion; equal
conversations are all prompt; where one side is the other's prefix, the shorter
completion is empty; NULL roles and texts are rendered empty, and differ from
empty ones only in ``role``; NULL turn numbers come first; NULL conversation ids
take no part; repeated rows of a turn are rendered each, in the order of their
texts, and count as a difference unless both sides repeat them; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm.common import read, stored

TRAINED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    none = F.lit("")
    return F.concat(F.lit("<|"), F.coalesce(role, none), F.lit("|>\n"), F.coalesce(text, none), F.lit("<|end|>\n"))


def format_pairs(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``turns``: (pair_id, side, turn, role, text), side 0 chosen and 1 rejected.
    Returns (pair_id, part, turn, role, rendered, train): part is ``prompt``
    (rendered once), ``chosen`` or ``rejected``; ``train`` is 1 where the loss
    counts; ``prompt_turns`` is the pair's first differing turn, NULL if none."""
    t = turns.filter(F.col("pair_id").isNotNull()).select("pair_id", "side", "turn", "role", "text")
    what = ["role", "text", F.col("role").isNull(), F.col("text").isNull()]
    digests = {"h": F.xxhash64(*what), "g": F.xxhash64(F.lit("turn"), *what)}
    one = lambda side, c: F.when(F.col("side") == side, c)
    at = F.coalesce(F.col("turn"), F.lit(-1 << 62))
    sides = t.withColumns({"at": at, **digests}).groupBy("pair_id", "at").agg(*[
        f(one(side, F.col(h).cast("decimal(38,0)") if f is F.sum else F.col(h))).alias(f"{name}{side}")
        for side in (0, 1) for name, f, h in (("n", F.count, "h"), ("total", F.sum, "h"), ("low", F.min, "h"), ("high", F.max, "h"),
                                              ("other", F.sum, "g"), ("least", F.min, "g"))])
    same = F.lit(True)
    for name in ("n", "total", "low", "high", "other", "least"):
        same = same & F.col(f"{name}0").eqNullSafe(F.col(f"{name}1"))
    split = sides.groupBy("pair_id").agg(F.min(F.when(~same, F.col("at"))).alias("split"))
    rows = t.withColumn("at", at).join(split, "pair_id")
    in_prompt = F.col("split").isNull() | (F.col("at") < F.col("split"))
    part = F.when(in_prompt, "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    return rows.filter(~in_prompt | (F.col("side") == 0)).select(
        "pair_id", part.alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"),
        (~in_prompt & F.coalesce(F.col("role") == trained, F.lit(False))).cast("int").alias("train"),
        F.when(F.col("split") > (-1 << 62), F.col("split")).alias("prompt_turns"))


def answers_swapped(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Pairs that share turns, one per conversation (pair_id is its conv_id).  A
    conversation without an answer of the ``trained`` role, or whose neighbour has
    none, has no rejected side; one row per repeated last answer is replaced by one."""
    c = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    last = stored(c.filter((F.col("role") == trained) & F.col("turn").isNotNull()).groupBy("conv_id")
                  .agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", F.col("x.turn").alias("last"), F.col("x.text").alias("answer")))
    partner = F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))
    swap = last.select("conv_id", "last").join(last.select(partner.alias("conv_id"), "answer"), "conv_id")
    chosen = c.select(F.col("conv_id").alias("pair_id"), F.lit(0).alias("side"), "turn", "role", "text")
    before = c.join(swap.select("conv_id", "last"), "conv_id").filter(F.col("turn") < F.col("last")) \
        .select(F.col("conv_id").alias("pair_id"), F.lit(1).alias("side"), "turn", "role", "text")
    answer = swap.select(F.col("conv_id").alias("pair_id"), F.lit(1).alias("side"), F.col("last").alias("turn"), F.lit(trained).alias("role"), F.col("answer").alias("text"))
    return chosen.unionByName(before).unionByName(answer)


def paired(formatted: DataFrame) -> DataFrame:
    """One row per pair: turns and characters of the prompt and of both completions,
    and how many of them the loss counts; sums with partial aggregates."""
    part = lambda p: F.col("part") == p
    size = F.char_length("rendered").cast("long")
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    one = F.lit(1).cast("long")
    return formatted.groupBy("pair_id").agg(
        *[total(part(p), one).alias(f"n_{p}_turns") for p in ("prompt", "chosen", "rejected")],
        *[total(part(p), size).alias(f"{p}_chars") for p in ("prompt", "chosen", "rejected")],
        *[total(part(p) & (F.col("train") == 1), size).alias(f"{p}_trained_chars") for p in ("chosen", "rejected")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every pair, beside its pair's sizes."""
    turns = stored(format_pairs(answers_swapped(read(spark, sf_dir, "conversations"))))
    return turns.join(paired(turns), "pair_id")


SQL = """
WITH last AS (
  SELECT conv_id, m.turn AS last, m.text AS answer FROM (
    SELECT conv_id, max({'turn': turn, 'text': text}) AS m FROM conversations WHERE role = 'assistant' GROUP BY conv_id)),
swap AS (SELECT a.conv_id, a.last, b.answer FROM last a JOIN last b ON b.conv_id = a.conv_id + 1 - 2 * (a.conv_id % 2)),
t AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations
  UNION ALL SELECT c.conv_id, 1, turn, role, text FROM conversations c JOIN swap s ON s.conv_id = c.conv_id WHERE turn < last
  UNION ALL SELECT conv_id, 1, last, 'assistant', answer FROM swap),
sides AS (
  SELECT pair_id, turn, list_sort(list({'r': role, 't': text}) FILTER (side = 0)) AS a,
         list_sort(list({'r': role, 't': text}) FILTER (side = 1)) AS b
  FROM t GROUP BY pair_id, turn),
split AS (SELECT pair_id, min(turn) FILTER (a IS DISTINCT FROM b) AS split FROM sides GROUP BY pair_id),
f AS (
  SELECT pair_id, CASE WHEN split IS NULL OR turn < split THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part,
         turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
         CASE WHEN turn >= split AND role = 'assistant' THEN 1 ELSE 0 END AS train, split AS prompt_turns
  FROM t JOIN split USING (pair_id)
  WHERE turn < split AND side = 0 OR turn >= split OR split IS NULL AND side = 0)
SELECT *, (count(*) FILTER (part = 'prompt') OVER p)::BIGINT AS n_prompt_turns,
       (count(*) FILTER (part = 'chosen') OVER p)::BIGINT AS n_chosen_turns,
       (count(*) FILTER (part = 'rejected') OVER p)::BIGINT AS n_rejected_turns,
       coalesce(sum(length(rendered)) FILTER (part = 'prompt') OVER p, 0)::BIGINT AS prompt_chars,
       coalesce(sum(length(rendered)) FILTER (part = 'chosen') OVER p, 0)::BIGINT AS chosen_chars,
       coalesce(sum(length(rendered)) FILTER (part = 'rejected') OVER p, 0)::BIGINT AS rejected_chars,
       coalesce(sum(length(rendered)) FILTER (part = 'chosen' AND train = 1) OVER p, 0)::BIGINT AS chosen_trained_chars,
       coalesce(sum(length(rendered)) FILTER (part = 'rejected' AND train = 1) OVER p, 0)::BIGINT AS rejected_trained_chars
FROM f WINDOW p AS (PARTITION BY pair_id)
"""
