"""Set-similarity self-join on word shingles, size-aware: small sets by subsets, large sets by inverted lists.

Two sets of sizes s and t have a Jaccard similarity of at least 4/5 only if they share c = ceil(4 (s + t) / 9) members.

* Light sets (size up to a boundary) enumerate their subsets of each size c that some partner asks for, so two that
  link meet in at least one list, and little else meets there.
* Heavy sets are entered in the inverted lists of the first s - ceil(4 s / 5) + 1 of their members in one global order.
  Two linked sets share a member there whatever the order is. Members are counted over all documents, and the order is rare ones
  (by hash), then frequent ones by the power of two of their count. So neither a passage of many documents nor the text that
  many near copies have in common opens a list for a document that has enough members of its own.
* The boundary is the size up to which enumerating costs less than scanning, from the sizes and list lengths counted
  over all documents. Light sets near the boundary are entered in both.

Lists are never expanded into pairs of rows. Equal sets are one class from the start. Of each list the first member is
compared with the others. Connected components of what links leave most lists with one component; in the others, the sets that may
still link with a set of another component, by what is left of both at the place where they meet, are compared with each
other inside of tasks that hold ``HELD`` members, block by block where a first member has more. A task gives a spanning
forest of its links. Comparison reads whole texts. All links between different components are found, so the
components are exact; links inside of one need not be.

The frequent members are at most ``MAX_FREQUENT`` at any input size, the most frequent ones. They only set the order.

Members and sets are named by 64-bit hashes. Defined results: a null text, an empty one or one without words has size 0 and
is its own component; a null doc_id
counts as the smallest and is given as null; rows that repeat a doc_id, or have none, are told apart by a hash of their texts; each of several equal rows is
returned; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import Scratch, checkpointed, components

MAX_FREQUENT, FREQUENT_FROM, MAX_LIGHT = 4_000_000, 6, 16
#: Bytes of a member's hash that counting goes by, members that one counting group adds up, and members that one comparison holds.
KEY_BYTES, COUNTED, HELD = 6, 2_000_000, 500_000
#: Rows (about 40 bytes each) up to which a broadcast of the wanted names replaces a shuffle of all texts.
BROADCAST_ROWS = 500_000
LEAST_ID = -(1 << 63)
_U = np.uint64


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def shared(s: int, t: int) -> int:
    """Members that sets of these sizes share at least if they link."""
    return -(-4 * (s + t) // 9)


def subset_sizes(s: int) -> list[int]:
    """The numbers of members that partners of a set of size s ask for."""
    return sorted({shared(s, t) for t in range((4 * s + 4) // 5, 5 * s // 4 + 1)})


def enumeration(s: int) -> int:
    return sum(comb(s, c) for c in subset_sizes(s))


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The light sizes are those up to it: the total cost of entries and of the rows compared is least there."""
    best, total, least = 0, 0.0, 0.0
    for s in range(1, MAX_LIGHT + 1):
        total += sizes.get(s, 0) * (enumeration(s) - prefix(s) * (1 + list_length))
        if total <= least:
            best, least = s, total
    return best


def _stats(docs: DataFrame) -> DataFrame:
    """Rows of kind 1: set size, sets of a partition; 2: document, its size, its set and the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sizes: dict[int, int] = {}
        for batch in batches:
            names, lens = [], []
            for x in shingles.sets(batch.column(1)):
                name = shingles.set_id(x) if len(x) else 0
                names.append(name)
                lens.append(len(x))
                if 0 < len(x) <= MAX_LIGHT and name not in seen:
                    seen.add(name)
                    sizes[len(x)] = sizes.get(len(x), 0) + 1
            yield rows(2, batch.column(0), lens, names, batch.column(2))
        yield rows(1, pa.array(list(sizes), pa.int64()), list(sizes.values()), [0] * len(sizes), [0] * len(sizes))

    def rows(kind: int, key: pa.Array, n, sid, th) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), key.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(th, pa.int64())], names=["kind", "key", "n", "sid", "th"])

    return docs.mapInArrow(run, "kind int, key long, n long, sid long, th long")


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, one plane for each byte, compressed."""
    import zstandard

    planes = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(KEY_BYTES, -1)
    gaps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    gaps[:, :KEY_BYTES] = planes.T
    return np.cumsum(gaps.view(_U).ravel(), dtype=_U)


def _member_counts(docs: DataFrame, members: int) -> DataFrame:
    """(key, n): the members (by the upper 48 bits of their hash) that at least FREQUENT_FROM sets have, and how many have them.
    Repeats of a set count once in a partition. Keys travel in packed runs, each to the group of its range of keys."""
    groups = max(1, -(-members // COUNTED))
    bounds = np.array([(g << 8 * KEY_BYTES) // groups for g in range(groups + 1)], dtype=_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for x in shingles.sets(batch.column(1)):
                name = shingles.set_id(x) if len(x) else 0
                if len(x) and name not in seen:
                    seen.add(name)
                    held.append(x >> _U(64 - 8 * KEY_BYTES))
                    size += len(x)
                    if size >= COUNTED:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        import zstandard

        keys, n = np.unique(np.concatenate(held), return_counts=True)
        at = np.searchsorted(keys, bounds)
        full = [g for g in range(groups) if at[g] < at[g + 1]]
        press = zstandard.ZstdCompressor(level=1)
        runs = [_pack(keys[at[g] : at[g + 1]]) for g in full]
        counts = [press.compress(n[at[g] : at[g + 1]].astype(np.uint32).tobytes()) for g in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(runs, pa.binary()), pa.array(counts, pa.binary())], names=["part", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        keys = np.concatenate([_unpack(k.as_py()) for k in table.column("keys")])
        n = np.concatenate([np.frombuffer(open_.decompress(c.as_py()), dtype=np.uint32) for c in table.column("counts")])
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[at], np.add.reduceat(n, at)
        often = n >= FREQUENT_FROM
        return pa.table({"key": pa.array(keys[often].astype(np.int64)), "n": pa.array(n[often])})

    return docs.mapInArrow(run, "part int, keys binary, counts binary").groupBy("part").applyInArrow(add, "key long, n long")


def _entries(docs: DataFrame, frequent, light: int) -> DataFrame:
    """(token, sid, n, rest): the list entries of every set; ``rest`` members of the set stand from this one on, in the order."""

    def tokens(x: np.ndarray, keys: np.ndarray, powers: np.ndarray, maybe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(x)
        if n <= light:
            for c in subset_sizes(n):
                at = np.array(list(combinations(range(n), c)), dtype=np.int64).reshape(-1, c)
                h = np.full(len(at), 0x9E37 * c + 1, dtype=_U)
                for k in range(c):
                    h = shingles.mix(h * _U(0xD6E8FEB86659FD93) + x[at[:, k]])
                yield h, np.full(len(h), n, dtype=np.int32)
        if 5 * n >= 4 * (light + 1):
            p = prefix(n)
            short = x >> _U(64 - 8 * KEY_BYTES)
            at = np.flatnonzero(maybe[short & _U(len(maybe) - 1)])
            place = np.minimum(np.searchsorted(keys, short[at]), len(keys) - 1)
            power = np.zeros(n, dtype=np.uint8)
            power[at] = np.where(keys[place] == short[at], powers[place], 0)
            yield x[np.argsort(power, kind="stable")[:p]], n - np.arange(p, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, powers = frequent.value
        maybe = np.zeros(1 << 24, dtype=bool)
        maybe[keys & _U(len(maybe) - 1)] = True
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            held = 0
            for x in shingles.sets(batch.column(1)):
                if not len(x):
                    continue
                name = shingles.set_id(x)
                if name in seen:
                    continue
                seen.add(name)
                for h, rest in tokens(x, keys, powers, maybe):
                    out.append((h, name, len(x), rest))
                    held += len(h)
                if held > 200_000:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple[np.ndarray, int, int, np.ndarray]]) -> pa.RecordBatch:
        lens = [len(o[0]) for o in out]
        names, sizes = (np.repeat(np.array([o[k] for o in out], dtype=t), lens) for k, t in ((1, np.int64), (2, np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), pa.array(names), pa.array(sizes), pa.array(np.concatenate([o[3] for o in out]))], names=["token", "sid", "n", "rest"])

    return docs.mapInArrow(run, "token long, sid long, n int, rest int")


def _lists(entries: DataFrame) -> DataFrame:
    """The entries of lists with several sets, each with the list's first entry. A list streams through its task in
    order; of what came before, only the first and the last entry are held."""
    names = ["token", "sid", "n", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (last entry, (sid, n, rest) of the first entry of its list, whether the last entry is out)
        for batch in batches:
            x = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
            if not len(x[0]):
                continue
            if held:
                x = [np.concatenate([np.array([h], dtype=c.dtype), c]) for h, c in zip(held[0], x, strict=True)]
            new = np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
            x = [c[new] for c in x]
            out = np.zeros(len(x[0]), dtype=bool)
            out[0] = bool(held and held[2])
            start = np.concatenate([[True], x[0][1:] != x[0][:-1]])
            group, at = np.cumsum(start) - 1, np.flatnonzero(start)
            first = [x[k][at] for k in (1, 2, 3)]
            several = np.bincount(group) > 1
            if held:
                for f, value in zip(first, held[1], strict=True):
                    f[0] = value
                several[0] |= held[2]
            emit = several[group] & ~out
            held = ([c[-1] for c in x], [f[-1] for f in first], bool(several[-1]))
            if emit.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[emit]) for c in (*x, *(f[group] for f in first))], names=[*names, "first", "first_n", "first_rest"])

    # Of a list of a common member, the set with the fewest rare ones before it is the likeliest original: it stands first.
    ordered = entries.repartition("token").sortWithinPartitions("token", F.col("rest").desc(), "sid")
    return ordered.mapInArrow(run, "token long, sid long, n int, rest int, first long, first_n int, first_rest int")


def _open(lists: DataFrame, reached: DataFrame) -> DataFrame:
    """(first, sid, n): the sets that may link with a set of another component in a list of several components, by sizes and places.

    At the first member that two sets share, what is left of either is at least what they have to share. So an entry
    meets sets of up to ``most`` = (9 rest - 4 n) / 4 members, and two entries each allow the other's size. For each list
    and size one row says what its entries allow and whether they are of one component; it precedes the entries
    in their stream, so that no list is held.
    """
    here = lists.join(reached, "sid", "left").select("token", "first", "sid", "n", F.floor((9 * F.col("rest") - 4 * F.col("n")) / 4).cast("int").alias("most"), F.coalesce("component", "sid").alias("component"))
    sizes = here.groupBy("token", "n").agg(F.max("most").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k"))
    # The first entry was compared with all others, so a list of two is done.
    mixed = sizes.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("k").alias("k")).filter("lo <> hi and k > 2").select("token")
    both = sizes.select("token", F.lit(0).alias("kind"), "n", "most", F.col("lo").alias("x"), F.col("hi").alias("y"), F.lit(0).cast("long").alias("first"))
    both = both.union(here.select("token", F.lit(1), "n", "most", "component", "sid", "first")).join(mixed, "token", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, table = None, np.zeros((4, 0), dtype=np.int64)  # sizes, what they allow, lowest and highest component
        for batch in batches:
            if not batch.num_rows:
                continue
            t, kind, n, most, x, y, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(at, [*at[1:], len(t)], strict=True):
                if kind[lo] == 0:
                    new = np.stack([n[lo:hi].astype(np.int64), most[lo:hi].astype(np.int64), x[lo:hi], y[lo:hi]])
                    table = np.concatenate([table, new], axis=1) if token == t[lo] else new
                    token = t[lo]
                    continue
                found = np.zeros(hi - lo, dtype=bool)
                for size, allows, low, high in table.T:
                    found |= (size <= most[lo:hi]) & (allows >= n[lo:hi]) & ((low != x[lo:hi]) | (high != x[lo:hi]))
                if found.any():
                    yield pa.RecordBatch.from_arrays([pa.array(first[lo:hi][found]), pa.array(y[lo:hi][found]), pa.array(n[lo:hi][found])], names=["first", "sid", "n"])

    # Not by the token itself: Spark 4.1 takes the union of two frames that are parted by it as parted by it, and leaves this exchange out,
    # although adaptive execution may have coalesced them unlike each other.
    return both.repartition(F.xxhash64("token")).sortWithinPartitions("token", "kind", "n").mapInArrow(run, "first long, sid long, n int").distinct()


def _stars(lists: DataFrame) -> DataFrame:
    """(task, side, sid, n): the first set of each list to the left, those it may link with, in parts of about HELD members, to the right."""
    pairs = lists.filter((F.col("first") != F.col("sid")) & (9 * F.least("rest", "first_rest") >= 4 * (F.col("n") + F.col("first_n")))).select("first", "first_n", "sid", "n").distinct()
    parts = pairs.groupBy("first", "first_n").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("parts"))
    right = pairs.join(parts.select("first", "parts"), "first").select(F.xxhash64("first", F.pmod(F.xxhash64("sid"), "parts").cast("int")).alias("task"), F.lit(1).alias("side"), "sid", "n")
    left = parts.select("first", "first_n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.xxhash64("first", "part").alias("task"), F.lit(0).alias("side"), F.col("first").alias("sid"), F.col("first_n").alias("n"))
    return left.union(right)


def _blocks(open_: DataFrame) -> DataFrame:
    """(task, side, sid, n): all sets of a first set with each other (side 2), or block by block where they have more than HELD members."""
    blocks = open_.groupBy("first").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("blocks"))
    placed = open_.join(blocks, "first").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    sent = placed.select("first", "sid", "n", "block", F.explode(each).alias("at"))
    side = F.when(F.col("at.i") == F.col("at.j"), 2).when(F.col("block") == F.col("at.i"), 0).otherwise(1)
    return sent.select(F.xxhash64("first", "at.i", "at.j").alias("task"), side.alias("side"), "sid", "n")


def _links(left: list[np.ndarray], right: list[np.ndarray] | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set to the left that links, its place and the places of the linked sets to the right (without ``right``, of
    the later ones to the left)."""
    others = left if right is None else right
    members, owner = np.concatenate(others), np.repeat(np.arange(len(others)), [len(x) for x in others])
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    sizes = np.array([len(x) for x in others])
    for k, x in enumerate(left if right is not None else left[:-1]):
        lo, hi = np.searchsorted(members, x, side="left"), np.searchsorted(members, x, side="right")
        lens = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.bincount(owner[at], minlength=len(others))
        near = 100 * both >= 80 * (len(x) + sizes - both)
        if right is None:
            near[: k + 1] = False
        if near.any():
            yield k, np.flatnonzero(near)


def _forest(names: np.ndarray, links: Iterator[tuple[int, np.ndarray]], shift: int) -> list[tuple[int, int]]:
    """The links, from the first sets to those from ``shift`` on, that join two trees."""
    tree, out = np.arange(len(names)), []
    for k, js in links:
        js = js + shift
        while len(js := js[tree[js] != tree[k]]):
            out.append((int(names[k]), int(names[js[0]])))
            tree[tree == tree[js[0]]] = tree[k]
    return out


def _verified(placed: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of sets that meet in a task, a spanning forest of each task's. Whole texts, packed, go to the tasks."""
    total, rows = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bins = max(1, total // HELD)
    wanted = placed.join(nodes.select("sid", "at"), "sid").select(F.col("at.doc").alias("doc"), F.col("at.th").alias("th"), "sid", "task", "side", F.pmod(F.xxhash64("task"), F.lit(bins)).cast("int").alias("bin"))
    found = docs.join(F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted, ["doc", "th"]).select("bin", "task", "side", "sid", "text")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        sent: set[tuple[int, int, int]] = set()
        last, done = None, b""
        for batch in batches:
            # Equal rows of one doc_id need not be sent again.
            fresh = [key not in sent and not sent.add(key) for key in zip(batch["task"], batch["side"], batch["sid"], strict=True)]
            batch, packed = batch[np.array(fresh, dtype=bool)], []
            for text in batch["text"]:
                if text != last:
                    last, done = text, press.compress(text.encode("utf-8", "surrogatepass"))
                packed.append(done)
            yield batch.drop(columns="text").assign(packed=packed)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        texts = group.drop_duplicates("sid")
        sets = dict(zip(texts["sid"], shingles.sets(pa.array([open_.decompress(p) for p in texts["packed"]], pa.large_binary())), strict=True))
        out = []
        # A row of the set may stand in the table several times.
        for _, task in group.drop_duplicates(["task", "side", "sid"]).groupby("task"):
            sids, side = task["sid"].to_numpy(), task["side"].to_numpy()
            if (side == 2).any():
                out += _forest(sids, _links([sets[s] for s in sids], None), 0)
            elif (side == 0).any() and (side == 1).any():
                left, right = sids[side == 0], sids[side == 1]
                out += _forest(np.concatenate([left, right]), _links([sets[s] for s in left], [sets[s] for s in right]), len(left))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return found.mapInPandas(send, "bin int, task long, side int, sid long, packed binary").groupBy("bin").applyInPandas(compare, "a long, b long")


def components_by_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row of ``docs``."""
    return _linked(docs, id_col, text_col).select(F.nullif("doc_id", F.lit(LEAST_ID)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(LEAST_ID)).alias("component_id"))


def originals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: of those with the smallest doc_id (none comes last), the one whose text has the
    smallest hash, and of rows equal in both the least. Rows without words stay, but of each doc_id one."""
    rows = _linked(docs, id_col, text_col)
    least = F.min(F.struct((F.col("doc_id") == LEAST_ID).alias("unnamed"), F.col("doc_id").alias("doc"), "th")).alias("r")
    kept = rows.filter("n_shingles > 0").groupBy("component").agg(least).select("r.doc", "r.th")
    wordless = rows.filter("n_shingles = 0")
    named = wordless.filter(F.col("doc_id") != LEAST_ID).groupBy("doc_id").agg(F.min("th").alias("th")).select(F.col("doc_id").alias("doc"), "th")
    every = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(docs[text_col].cast("string")).alias("th"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = every.join(kept.union(named), ["doc", "th"], "left_semi").groupBy("doc", "th").agg(F.min("row").alias("row")).select("row.*")
    unnamed = wordless.filter(F.col("doc_id") == LEAST_ID).select(F.col("doc_id").alias("doc"), "th").distinct()
    return one.union(every.join(unnamed, ["doc", "th"], "left_semi").select("row.*"))


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (LEAST_ID for none), th (hash of the text), n_shingles, component (null without words) and component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    stats = scratch.write(_stats(docs), "stats")
    sizes = {r["key"]: r["n"] for r in stats.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("key") <= MAX_LIGHT).collect()}
    members = stats.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = scratch.write(_member_counts(docs, members), "counts")
    power = F.floor(F.log2("n")).cast("int")
    by_power = sorted(((r["power"], r["k"], r["entries"]) for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("entries")).collect()), reverse=True)
    floor, total = 0, 0
    for p, k, _ in by_power:
        total += k
        if total > MAX_FREQUENT:
            floor = p + 1
            break
    often = counts.filter(power >= floor).select("key", power.alias("power")).toArrow()
    keys, powers = often.column(0).to_numpy().astype(_U), often.column(1).to_numpy().astype(np.uint8)
    order = np.argsort(keys)
    frequent = (keys[order], powers[order]) if len(keys) else (np.zeros(1, _U), np.zeros(1, np.uint8))
    sets_, entries_of_frequent = sum(sizes.values()), sum(e for _, _, e in by_power)
    light = boundary(sizes, entries_of_frequent / max(1, sets_ + entries_of_frequent) + 1)
    rows = stats.filter("kind = 2").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "sid", "th")
    # ``at`` is one row of the set: a doc_id alone would name other texts too.
    nodes = rows.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").alias("doc"), "th")).alias("at"))
    lists = scratch.write(_lists(_entries(docs, spark.sparkContext.broadcast(frequent), light)), "lists")
    scratch.drop("counts")

    stars = scratch.write(_stars(lists), "stars")
    edges = scratch.write(_verified(stars, docs, nodes), "edges0")
    open_ = scratch.write(_open(lists, components(edges).select(F.col("node").alias("sid"), "component")), "open")
    scratch.drop("lists", "stars")
    blocks = scratch.write(_blocks(open_), "blocks")
    edges = scratch.write(edges.union(_verified(blocks, docs, nodes)), "edges")
    reached = components(edges).select(F.col("node").alias("sid"), "component")
    scratch.drop("edges0", "edges", "open", "blocks")

    of = nodes.join(reached, "sid", "left").select("sid", "rep", F.coalesce("component", "sid").alias("component"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = checkpointed(of.join(least, "component").select("sid", "component", "component_id"))
    linked = rows.filter("n_shingles > 0").join(named, "sid").select("doc_id", "th", "n_shingles", "component", "component_id")
    return linked.union(rows.filter("n_shingles = 0").select("doc_id", "th", "n_shingles", F.lit(None).cast("long"), F.col("doc_id").alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return components_by_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
