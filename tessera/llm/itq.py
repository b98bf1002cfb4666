"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated unit vectors are bits that keep angles. (They are not
centred first: around the mean of a large group of near copies, these would point everywhere.) A code is cut into substrings, and each substring is a table: two vectors meet where they have a label and a substring in
common. As many tables are made as it takes (with further rotations, learned from other starts) for two vectors at the threshold angle to meet
in one with a probability of at least ``recall``. What meets is compared with the original vectors in double precision, and linked if
the cosine is at least the threshold.

Equal vectors of a label are one from the start, with a count. A pair that meets in several tables is counted in the
first of them only, which both codes show without a shuffle. Lists longer than ``BLOCK`` are cut into blocks and compared block by
block in separate tasks. Of a block's links only the counts for each vector and a spanning forest leave the task; components come from the forests.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null label or vectors of a
different dimension than others; rows that repeat a vec_id are vectors of their own with that id; an empty table gives no rows.
The fit's sample is bounded by ``sample`` rows and ``SAMPLE_BYTES``; every row is in the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components

#: Rows of a block of a long list, and rows whose short lists are compared by one call.
BLOCK, TOGETHER = 1024, 8192
#: Bytes of doubles that the fit's sample has at most.
SAMPLE_BYTES = 64 << 20


def rotations(x: np.ndarray, count: int, rounds: int = 50, seed: int = 11) -> list[np.ndarray]:
    """Each minimises the distance between rotated unit vectors and their signs, from its own random start."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(rounds if len(x) > x.shape[1] else 0):
            u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ v).T
        out.append(r)
    return out


def plan(rows: int, dimension: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, number of tables): substrings as long as keeps the lists of ``rows`` short, tables as recall asks."""
    bits = min(dimension, max(4, math.ceil(math.log2(max(rows, 2)))))
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _keys(vectors: np.ndarray, turns: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """The table keys of the vectors, a column for each table."""
    per = vectors.shape[1] // bits
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    out = []
    for t in range(tables):
        code = unit @ turns[t // per][:, (t % per) * bits : (t % per + 1) * bits] > 0
        out.append(code @ weights)
    return np.stack(out, axis=1)


def links(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = 0.995, sample: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    kind = "array<float>" if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", "v", sound.alias("sound"))
    named = rows.filter("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("k"))
    unique = scratch.write(named.select("label", "v", "rep", "k", F.xxhash64("label", "v").alias("node"), F.size("v").alias("d")), "unique")
    shape = {r["d"]: r["n"] for r in unique.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not shape:
        return alone.select("*", F.lit(True).alias("kept"))
    edges, counts = [], []
    for d, n in sorted(shape.items()):
        of = unique.filter(F.col("d") == d)
        bits, tables = plan(n, d, threshold, recall)
        most = max(1, min(sample, SAMPLE_BYTES // (8 * d)))
        drawn = of.orderBy(F.xxhash64("node"), "node").limit(most).select("v").toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        turns = rotations(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), -(-tables // (d // bits)))
        met = _met(of, spark.sparkContext.broadcast((turns, bits, tables)), threshold, scratch, d)
        edges.append(met.filter("kind = 1").select("a", "b"))
        counts.append(met.filter("kind = 0").select("a", F.col("b").alias("k")))
    joined = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(joined(frames[1:]))
    reached = components(joined(edges)).select(F.col("node"), "component")
    scratch.drop(*(f"entered{d}" for d in shape))
    more = joined(counts).groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("more"))
    nodes = unique.select("label", "v", "rep", "k", "node").join(reached, "node", "left").join(more, "node", "left")
    nodes = nodes.select("label", "v", "rep", F.coalesce("component", "node").alias("component"), (F.col("k") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = nodes.join(least, "component").select("label", "v", "n_links", "component_id")
    linked = rows.filter("sound").join(of, ["label", "v"]).select("vec_id", "n_links", "component_id")
    return linked.union(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _met(unique: DataFrame, model, threshold: float, scratch: Scratch, d: int) -> DataFrame:
    """kind 0: (a, b) = a vector and how many rows it links with; kind 1: links that join what the block has linked."""

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns, bits, tables = model.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                keys = _keys(np.stack(part["v"].to_numpy()).astype(float), turns, bits, tables)
                yield pd.DataFrame({"label": np.repeat(part["label"].to_numpy(), tables), "turn": np.tile(np.arange(tables, dtype=np.int32), len(part)), "key": keys.ravel(), "node": np.repeat(part["node"].to_numpy(), tables)})

    entered = scratch.write(unique.select("label", "node", "v").mapInPandas(enter, "label long, turn int, key long, node long"), f"entered{d}")
    many = entered.groupBy("label", "turn", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("*", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    small = many.filter("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, small // TOGETHER)
    placed = entered.join(many, ["label", "turn", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block i meets blocks j >= i: a row goes to each pair of blocks that its own is one of.
    mine = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    sent = placed.select("label", "turn", "key", "node", "block", "blocks", F.explode(mine).alias("at")).select("label", "turn", "key", "node", "block", "blocks", "at.i", "at.j")
    lone = F.pmod(F.xxhash64("label", "turn", "key"), F.when(F.col("blocks") == 1, F.lit(bins)))
    sent = sent.withColumn("bin", F.coalesce(lone, F.xxhash64("label", "turn", "key"))).join(unique.select("node", "v", "k"), "node")

    def compare(bin_: pd.DataFrame) -> pd.DataFrame:
        """All lists of a bin, or two blocks of a long list."""
        return pd.concat([one(group) for _, group in bin_.groupby(["label", "turn", "key"], sort=False)])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        turns, bits, tables = model.value
        turn, i, j = group["turn"].iloc[0], group["i"].iloc[0], group["j"].iloc[0]
        nodes, weights = group["node"].to_numpy(), group["k"].to_numpy()
        v = np.stack(group["v"].to_numpy()).astype(float)
        earlier = _keys(v, turns, bits, int(turn)) if turn else None
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        place = np.arange(len(group))
        left, right = (place, place) if i == j else (np.flatnonzero(group["block"] == i), np.flatnonzero(group["block"] == j))
        more, parent = np.zeros(len(group), dtype=np.int64), list(range(len(group)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            near = unit[rows] @ unit[right].T >= threshold
            if i == j:
                near &= rows[:, None] < right[None, :]
            if earlier is not None:
                x, y = np.nonzero(near)
                again = (earlier[rows[x]] == earlier[right[y]]).any(axis=1)
                near[x[again], y[again]] = False
            more[rows] += near @ weights[right]
            more[right] += near.T @ weights[rows]
            for x, y in zip(*np.nonzero(near), strict=True):
                a, b = root(int(rows[x])), root(int(right[y]))
                if a != b:
                    parent[b] = a
        roots = np.array([root(x) for x in range(len(group))])
        tied, counted = np.flatnonzero(roots != place), np.flatnonzero(more)
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], dtype=np.int32), [len(counted), len(tied)]), "a": np.concatenate([nodes[counted], nodes[tied]]), "b": np.concatenate([more[counted], nodes[roots[tied]]])})

    return scratch.write(sent.groupBy("bin", "i", "j").applyInPandas(compare, "kind int, a long, b long"), f"met{d}")


def query(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
