"""Chat formatting after a cumulative-snapshot collapse, in DataFrame functions only.

Logs keep a conversation each time it grows, so many are the beginning of a longer one. Turns are hashed with their place, and
the hash of a prefix is the exclusive-or of its turns' hashes (two independent 64-bit ones): it rolls on by one turn at
a time, and two prefixes are equal exactly if place, role and text of all their turns are. Equal conversations are one class,
named by the smallest conv_id. An anti-join against the proper prefixes of all conversations leaves the maximal ones,
which are then rendered.

A conversation may be of any length and its turns may all have one number: turns are dealt by ranges of all their columns, a tie by their place in the input,
and written once; places and running hashes are made inside of those blocks, and only a row for each block is put in order for the
conversation. Prefixes are grouped before the shuffle, so a conversation logged a thousand times costs a row for each task. Rendering makes
one text for each maximal conversation.

Defined results: turns are in the order of turn, role and text, nulls first, and repeated rows are separate turns; a null role or text
differs from an empty one and renders as nothing; each row with a null conv_id is a conversation of one turn (equal ones are one class, as with others);
texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

CONV = ["conv", "block"]


def _placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns with the block they are in and ``at``, their place in the conversation from 1."""
    keys = ["conv", "turn", "role", "text", "tie"]
    dealt = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = scratch.write(dealt.select("conv", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at"), "role", "text"), "ordered")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ordered.groupBy(*CONV).agg(F.count(F.lit(1)).alias("k")).select(*CONV, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip"))
    ranked = ordered.withColumn("rank", F.row_number().over(Window.partitionBy(*CONV).orderBy("at")))
    placed = scratch.write(ranked.join(blocks, CONV).select(*CONV, (F.col("skip") + F.col("rank")).alias("at"), "role", "text"), "placed")
    scratch.drop("ordered")
    return placed


def _hashes() -> list[Column]:
    """Two hashes of a turn at its place."""
    return [F.xxhash64(F.lit(seed), "at", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))) for seed in (1, 2)]


def _prefixes(placed: DataFrame) -> DataFrame:
    """(conv, at, h1, h2): the hashes of the first ``at`` turns."""
    turns = placed.select(*CONV, "at", *[h.alias(f"g{k}") for k, h in enumerate(_hashes(), 1)])
    running = Window.partitionBy(*CONV).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy(*CONV).agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2")).select(*CONV, *[F.coalesce(F.bit_xor(f"g{k}").over(before), F.lit(0)).alias(f"s{k}") for k in (1, 2)])
    inside = turns.select(*CONV, "at", *[F.bit_xor(f"g{k}").over(running).alias(f"r{k}") for k in (1, 2)])
    return inside.join(blocks, CONV).select("conv", "at", *[F.col(f"r{k}").bitwiseXOR(F.col(f"s{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(prefixes: DataFrame, lone: DataFrame) -> DataFrame:
    """(conv, n, copies, role, text): one of each conversation that begins no longer one. ``lone`` are turns without a conversation; a
    class of such turns only has no conv, but the turn's role and text."""
    ends = prefixes.groupBy("conv").agg(F.max("at").alias("n"))
    marked = prefixes.join(ends, "conv").select("conv", "at", "h1", "h2", (F.col("at") == F.col("n")).alias("whole"))
    none = F.lit(None).cast("string")
    whole = marked.filter("whole").select("conv", "at", "h1", "h2", none.alias("role"), none.alias("text"))
    own = lone.withColumn("at", F.lit(1).cast("long")).select(F.lit(None).cast("long"), "at", *_hashes(), "role", "text")
    classes = whole.union(own).groupBy("at", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"), F.max("role").alias("role"), F.max("text").alias("text"))
    begun = marked.filter("not whole").select("at", "h1", "h2").distinct()
    return classes.join(begun, ["at", "h1", "h2"], "left_anti").select("conv", F.col("at").alias("n"), "copies", "role", "text")


def render(conversations: DataFrame, start: str = "<|", end: str = "|>", stop: str = "<|end|>") -> DataFrame:
    """conv_id, n_turns, copies and the rendered text of the maximal conversations (conv_id, turn, role, text)."""
    scratch = Scratch(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    placed = _placed(turns.filter("conv is not null"), scratch)
    kept = scratch.write(maximal(_prefixes(placed), turns.filter("conv is null").select("role", "text")), "kept")
    one = lambda role, text: F.concat(F.lit(start), F.coalesce(role, F.lit("")), F.lit(f"{end}\n"), F.coalesce(text, F.lit("")), F.lit(f"{stop}\n"))
    named = placed.join(kept.filter("conv is not null").select("conv", "n", "copies"), "conv")
    whole = named.groupBy("conv", "n", "copies").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    lines = F.transform("turns", lambda t: one(t["role"], t["text"]))
    rendered = whole.select(F.col("conv").alias("conv_id"), F.col("n").alias("n_turns"), "copies", F.array_join(lines, "").alias("rendered"))
    lone = kept.filter("conv is null").select(F.col("conv").alias("conv_id"), F.col("n").alias("n_turns"), "copies", one(F.col("role"), F.col("text")).alias("rendered"))
    return rendered.union(lone)


def query(spark, sf_dir: str) -> DataFrame:
    found = render(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return found.select("conv_id", "n_turns", "copies", F.length("rendered").cast("long").alias("rendered_chars"), F.md5("rendered").alias("rendered_md5"))


SQL = """
WITH named AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations),
c AS (
  SELECT conv_id,
         list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM named GROUP BY conv_id, lone),
k AS (SELECT t, min(conv_id) AS conv_id, count(*) AS copies, any_value(rendered) AS rendered FROM c GROUP BY t)
SELECT conv_id, CAST(len(t) AS BIGINT) AS n_turns, copies, CAST(length(rendered) AS BIGINT) AS rendered_chars, md5(rendered) AS rendered_md5
FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.t[1] = k.t[1] AND len(b.t) > len(k.t) AND b.t[1:len(k.t)] = k.t)
"""
