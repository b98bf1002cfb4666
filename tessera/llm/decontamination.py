"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become words (lower case, everything but letters and digits separates), words become 64-bit hashes. At every place
of every text each mask picks the words at its positions and hashes them; positions it leaves out may differ. Hashes of
documents meet those of the benchmark in a join, and a meeting names an alignment of a document with an item. Along it
words are compared one by one: a match counts 1, a substitution -2, and the best stretch decides. A document is
contaminated by an item if that stretch reaches ``min_score``, or the item's length where that is less. An item of fewer than
``WHOLE`` words also counts if ``SHARE`` percent of all its words match along the alignment; with the mask ``NARROW``, which
only items of SPAN words need, some mask meets wherever the others are. With ``short_items`` (as in the query and the pipeline) items
of fewer words than a mask spans are met by a hash of all their words: those of ``PHRASE`` words and more anywhere in a
document, shorter ones, which are no evidence inside of a text, where they are the whole document.

Hashing places is one pass of generated code over the documents. The benchmark's side of the join is broadcast only up
to ``BROADCAST_SEEDS`` rows, and is shuffled beyond. Alignments are grouped before the shuffle, so that a passage that
recurs costs a row for each document. Words of a document are read again only where it has an alignment.

Defined results: null texts and texts without words are never hit, nor do items without words hit; an
empty table gives no rows; rows that repeat a doc_id or have none are a document for each distinct text (named by its 64-bit
hash ``th``), each with a row of its own in the result, and only those that hold a passage go; texts of any length are read whole; of stretches with equal scores
the one with more matches counts, then the one that begins first in the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Positions that each mask reads, of SPAN.
MASKS, SPAN = ((0, 1, 3, 4, 6, 8), (0, 2, 3, 6, 7, 8), (0, 1, 2, 5, 7, 8)), 9
NARROW, WHOLE, SHARE, PHRASE, PERIODS = (0, 1, 3, 4, 6, 7), 20, 85, 5, 4
BROADCAST_SEEDS, BROADCAST_DOCS = 2_000_000, 1_000_000
LEAST_ID = -(1 << 63)


def words(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    found = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _inside_run(words: Column, at: Column) -> Column:
    """Do the words from the place on repeat with a period of up to PERIODS, as do those up to it? What meets there also meets at the ends of the run."""
    found = F.lit(False)
    for q in range(1, PERIODS + 1):
        same = F.slice(words, at + 1 - q, SPAN + q) == F.slice(words, at + 1, SPAN + q)
        found = found | F.when((at >= q) & (at + SPAN + q <= F.size(words)) & (F.try_element_at(words, at + 1) == F.try_element_at(words, at + 1 + q)), same).otherwise(False)
    return found


def _seeds(rows: DataFrame, keep: list[str], narrow: Column, runs_cut: bool = False) -> DataFrame:
    """keep, ``at`` (the place) and ``seed`` for each mask at each place of ``words``; NARROW's only where ``narrow``."""
    span = F.when(narrow, NARROW[-1] + 1).otherwise(SPAN)
    places = rows.select(*keep, "words", narrow.alias("narrow"), F.explode(F.when(F.size("words") >= span, F.sequence(F.lit(0), F.size("words") - span))).alias("at"))
    if runs_cut:
        places = places.filter(~_inside_run(F.col("words"), F.col("at")))
    hashed = lambda mask, k: F.xxhash64(*[F.element_at("words", F.col("at") + (p + 1)) for p in mask], F.lit(k))
    wide, slim = [hashed(mask, k) for k, mask in enumerate(MASKS)], hashed(NARROW, len(MASKS))
    fits = F.col("at") <= F.size("words") - SPAN
    return places.select(*keep, "at", F.explode(F.when(fits & F.col("narrow"), F.array(*wide, slim)).when(fits, F.array(*wide)).otherwise(F.array(slim))).alias("seed"))


def _short(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """keep, ``at`` and ``seed`` of all runs of ``words`` that are as long as a short item."""
    size, none = F.size("words"), F.array().cast("array<int>")
    runs = [F.when(size >= n if n >= PHRASE else size == n, F.sequence(F.lit(0), size - n)).otherwise(none) for n in sizes]
    hashed = lambda n: lambda at: F.struct(at.alias("at"), F.xxhash64(F.slice("words", at + 1, n), F.lit(n)).alias("seed"))
    seeds = [F.transform(run, hashed(n)) for n, run in zip(sizes, runs, strict=True)]
    return rows.select(*keep, F.explode(F.flatten(F.array(*seeds))).alias("s")).select(*keep, "s.at", "s.seed")


def _best_stretch(doc: Column, item: Column, shift: Column) -> Column:
    """(score, matches, start in the item, end in the item) of the best stretch, and all matches, where doc[k + shift] stands beside item[k]."""
    skip = F.greatest(-shift, F.lit(0))
    length = F.least(F.size(item) - skip, F.size(doc) - F.greatest(shift, F.lit(0)))
    same = F.zip_with(F.slice(doc, F.greatest(shift, F.lit(0)) + 1, length), F.slice(item, skip + 1, length), lambda x, y: x == y)
    zero = F.struct(*[F.lit(0).alias(n) for n in ("at", "score", "matches", "start", "best", "best_matches", "best_start", "best_end", "all")])

    def step(s: Column, hit: Column) -> Column:
        grown = s["score"] + F.when(hit, 1).otherwise(-2)
        fresh = s["score"] <= 0
        score = F.when(fresh, F.when(hit, 1).otherwise(0)).otherwise(grown)
        matches = F.when(fresh, F.lit(0)).otherwise(s["matches"]) + F.when(hit, 1).otherwise(0)
        start = F.when(fresh, s["at"]).otherwise(s["start"])
        better = score > s["best"]
        return F.struct(
            (s["at"] + 1).alias("at"), score.alias("score"), matches.alias("matches"), start.alias("start"),
            F.when(better, score).otherwise(s["best"]).alias("best"), F.when(better, matches).otherwise(s["best_matches"]).alias("best_matches"),
            F.when(better, start).otherwise(s["best_start"]).alias("best_start"), F.when(better, s["at"] + 1).otherwise(s["best_end"]).alias("best_end"),
            (s["all"] + F.when(hit, 1).otherwise(0)).alias("all"),
        )

    return F.aggregate(same, zero, step, lambda s: F.struct(s["best"].alias("score"), s["best_matches"].alias("matches"), (s["best_start"] + skip).alias("start"), (s["best_end"] + skip).alias("end"), s["all"].alias("all")))


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(docs[id_col].cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(docs[text_col].cast("string")).alias("th")]


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: int = 13, short_items: bool = False) -> DataFrame:
    """doc, th, item_id and the best stretch s for each contaminating pair."""
    scratch, key = Scratch(docs.sparkSession), ["doc", "th"]
    doc = docs.select(*_key(docs, id_col, text_col), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    items = scratch.write(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text).cast("string")).alias("item_words")).filter(F.size("item_words") >= (1 if short_items else SPAN)), "items")
    named = items.withColumnRenamed("item_words", "words")
    long_, sizes = named.filter(F.size("words") >= SPAN), sorted(r["n"] for r in named.select(F.size("words").alias("n")).filter(F.col("n") < SPAN).distinct().collect())
    narrow = long_.filter(F.size("words") == SPAN).count() > 0
    seeds = _seeds(long_, ["item"], F.size("words") == SPAN, runs_cut=True).withColumnRenamed("at", "item_at")
    if sizes:
        seeds = seeds.union(_short(named.filter(F.size("words") < SPAN), ["item"], sizes))
    seeds = scratch.write(seeds, "seeds")
    few = seeds.count() <= BROADCAST_SEEDS
    read = doc.select(*key, words(F.col("text")).alias("words"))
    places = _seeds(read, key, F.lit(narrow))
    if sizes:
        places = places.union(_short(read, key, sizes))
    met = places.join(F.broadcast(seeds) if few else seeds, "seed")
    aligned = scratch.write(met.select(*key, "item", (F.col("at") - F.col("item_at")).alias("shift")).groupBy(*key, "item").agg(F.collect_set("shift").alias("shifts")), "aligned")
    scratch.drop("seeds")
    hit = aligned.select(*key).distinct()
    again = doc.join(F.broadcast(hit) if hit.count() <= BROADCAST_DOCS else hit, key, "left_semi").dropDuplicates(key).select(*key, words(F.col("text")).alias("words"))
    n, size = F.size("item_words"), F.size("words")

    def best(shift: Column) -> Column:
        s = _best_stretch(F.col("words"), F.col("item_words"), shift)
        return F.struct(s["score"].alias("score"), s["matches"].alias("matches"), (-s["start"]).alias("back"), s["end"].alias("end"), s["all"].alias("all"))

    def enough(s: Column) -> Column:
        share = (n >= SPAN) & (n < WHOLE) & (100 * s["all"] >= SHARE * n)
        return ((s["score"] >= F.least(F.lit(min_score), n)) | share) & ((n >= PHRASE) | (size == n))

    # A row for each pair: the shifts are at most as many as both have words, and words stand there once.
    found = aligned.join(again, key).join(items, "item").select(*key, "item_id", F.array_max(F.filter(F.transform("shifts", best), enough)).alias("s")).filter("s is not null")
    return found.groupBy(*key, "item_id").agg(F.max("s").alias("s"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """doc_id, item_id, score, matches and the stretch (start, end) in the item's words, for each contaminating pair."""
    best = _overlaps(docs, benchmark, id_col, **how)
    return best.select(F.nullif("doc", F.lit(LEAST_ID)).alias("doc_id"), "item_id", F.col("s.score").alias("score"), F.col("s.matches").alias("matches"), (-F.col("s.back")).alias("item_start"), F.col("s.end").alias("item_end"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated documents."""
    hit = _overlaps(docs, benchmark, id_col, text_col, **how).select(F.col("doc").alias("_hit"), F.col("th").alias("_th")).distinct()
    doc, th = _key(docs, id_col, text_col)
    return docs.join(hit, (doc == hit["_hit"]) & (th == hit["_th"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)
