"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters is one space, and the n-grams of one to three characters are
hashed into a fixed number of buckets. Counting runs on all learning documents, summed per partition before anything is
shuffled; the table of log probabilities (for each language the buckets it has, 6 bytes each, and one value for all others)
goes to every task, where batches of texts are scored in numpy by a sparse sum: one gather of table columns and one sum by
document. All languages of the learning documents are learned. A task holds at most ``HELD`` counts at a time before it
gives them on, and scores so many documents at a time that ``HELD`` sums hold them for all languages.

Defined results: a null text or one without a letter is
``und`` with score 0, as is everything when nothing could be learned; equal sums give the alphabetically first language; texts of any length are read whole,
in pieces of ``PIECE`` characters with an overlap that keeps every n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.toxicity import held_out

BUCKET_BITS, ORDERS, PIECE = 16, 3, 200_000
HELD = 4_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, document of each bucket, documents that have a letter), for about PIECE characters at a time."""
    held: list[tuple[int, str, int]] = []
    size = 0
    for k, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), PIECE):
            skip = at - _back(text, at)
            held.append((k, text[at - skip : at + PIECE], skip))
            size += len(held[-1][1])
            if size >= PIECE:
                yield _buckets(held)
                held, size = [], 0
    if held:
        yield _buckets(held)


def _back(text: str, at: int) -> int:
    """Where to begin so that ORDERS letters or whole runs of other characters stand before ``at``."""
    seen = 0
    while at > 0 and seen < ORDERS:
        at -= 1
        seen += text[at].isalpha() or at == 0 or text[at - 1].isalpha()
    return at


def _buckets(held: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(t for _, t, _ in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.array([len(t) for _, t, _ in held])
    piece = np.repeat(np.arange(len(held)), lens)
    starts = np.cumsum(lens) - lens
    fresh = np.arange(len(codes)) - starts[piece] >= np.array([s for _, _, s in held])[piece]
    letter = _letters()[codes]
    first = np.zeros(len(codes), dtype=bool)
    first[starts] = True
    keep = letter | first
    keep[1:] |= letter[:-1]
    x = np.where(letter, codes, 32)[keep].astype(np.uint32)
    piece, fresh, lettered = piece[keep], fresh[keep], np.unique(piece[letter])
    docs = np.array([k for k, _, _ in held])
    found, owner = [], []
    h = np.zeros(len(x), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        h = x if n == 1 else h[1:] * np.uint32(0x9E3779B1) + x[n - 1 :]
        whole = fresh[n - 1 :] & (piece[n - 1 :] == piece[: len(piece) - n + 1])
        mixed = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        mixed = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)
        found.append(mixed[whole])
        owner.append(piece[n - 1 :][whole])
    return np.concatenate(found), docs[np.concatenate(owner)], docs[lettered]


@dataclass(frozen=True)
class Model:
    """Languages in order; language k has the log probabilities ``logs`` of ``buckets`` from starts[k] to starts[k + 1], and
    ``rest[k]`` for any other bucket."""

    langs: list[str]
    prior: np.ndarray
    rest: np.ndarray
    starts: np.ndarray
    buckets: np.ndarray
    logs: np.ndarray

    def column(self, k: int) -> np.ndarray:
        column, own = np.full(1 << BUCKET_BITS, self.rest[k], dtype=np.float32), slice(self.starts[k], self.starts[k + 1])
        column[self.buckets[own]] = self.logs[own]
        return column


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model | None:
    """What all rows teach whose language is known; None if there are none."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not docs:
        return None
    langs = sorted(docs)
    place = {v: k for k, v in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        dense = np.zeros(len(langs) << BUCKET_BITS, dtype=np.int64) if len(langs) << BUCKET_BITS <= HELD else None
        for batch in batches:
            of = batch["lang"].map(place).to_numpy(dtype=np.int64)
            for buckets, doc, _ in _pieces(batch["text"].tolist()):
                if dense is not None:
                    dense += np.bincount((of[doc] << BUCKET_BITS) + buckets, minlength=len(dense))
                    continue
                new, n = np.unique((of[doc] << BUCKET_BITS) + buckets, return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield pd.DataFrame({"key": keys, "n": counts})
                    keys, counts = keys[:0], counts[:0]
        if dense is not None:
            keys = np.flatnonzero(dense)
            counts = dense[keys]
        yield pd.DataFrame({"key": keys, "n": counts})

    table = rows.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (table.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    lang = keys >> BUCKET_BITS
    total = np.bincount(lang, weights=n, minlength=len(langs)) + smoothing * (1 << BUCKET_BITS)
    prior = np.log(np.array([docs[v] for v in langs]) / sum(docs.values()))
    logs, rest = np.log((n + smoothing) / total[lang]), np.log(smoothing / total)
    starts = np.searchsorted(lang, np.arange(len(langs) + 1))
    return Model(langs, prior.astype(np.float32), rest.astype(np.float32), starts, (keys & ((1 << BUCKET_BITS) - 1)).astype(np.uint16), logs.astype(np.float32))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the posterior of that language) for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        names = np.array(m.langs, dtype=object)
        columns = [m.column(k) for k in range(len(names))] if len(names) << BUCKET_BITS <= HELD else None
        step = max(1, HELD // len(names))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.iloc[at : at + step]
                sums, lettered = np.tile(m.prior.astype(float), (len(batch), 1)), np.zeros(len(batch), dtype=bool)
                for buckets, doc, letters in _pieces(batch["text"].tolist()):
                    lettered[letters] = True
                    for k in range(len(names)):
                        column = columns[k] if columns else m.column(k)
                        sums[:, k] += np.bincount(doc, weights=column[buckets], minlength=len(batch))
                best = sums.argmax(axis=1)
                score = 1 / np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": np.where(lettered, names[best], "und"), "score": np.where(lettered, score, 0.0)})

    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
