"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, and every window of a text is compressed
with both. Which has the shorter output, and by how many bytes, is the evidence. How many windows pass each threshold of
bytes, either way, is turned into a probability by a logistic calibration, fitted on labelled documents
that the dictionaries at hand have not seen: the sample is dealt into ``FOLDS``, each is measured with dictionaries of the others,
and the final dictionaries are of all.

A toxic document differs from an ordinary one in a few places, and a dictionary trained on all of its text spends
its bytes on what both classes have, so that chance decides which of the two matches a window better. So either dictionary has
a small part trained on the places that are distinctive of its class, where every ``GRAM`` bytes are ``lift`` times as
frequent as in the other class, in front of a common part, trained on windows of ordinary text. Near copies among the training documents would make their own
rare words look distinctive: a document that shares one of four minima of hashed word triples with an earlier one is
left out of the fit.

Only the fit is bounded: at most ``max_rows`` labelled documents of either class, in the order of a hash of their id, and
of a document of more than ``PIECES`` pieces of ``PIECE`` characters that many pieces, in the order of a hash. Scoring covers whole texts, which stay in their task. Defined results: a
null or empty text has no window, and gets the score of no evidence; without labelled rows of both classes every score is 0; repeated rows get
equal scores; an empty table gives no rows; ids and labels may be null (such rows teach nothing).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
WINDOW, LEVEL, STEPS = 12, 9, 6
GRAM, MARGIN, FOLDS, PIECE, PIECES = 7, 1, 3, 4000, 16
#: Bytes of the distinctive and of the common part of a dictionary; sizes of segments to make the former of.
OWN, COMMON, SEGMENTS = 2 << 10, 64 << 10, (16, 24, 32, 48, 64, 128)
#: The compressor does not look for matches in the last bytes of its input; these stand there.
_TAIL = bytes(range(1, 10))


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _windows(words: list[str], size: int = WINDOW) -> list[bytes]:
    return [f" {' '.join(words[i : i + size])} ".encode() for i in range(0, len(words), size)]


def _unlike(texts: list[str]) -> list[list[str]]:
    """The words of the texts, without those texts that look like copies of an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = _words(text)
        hashes = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], dtype=np.uint64)
        keys = [(k, int((hashes * np.uint64(m) % np.uint64(4294967291)).min())) for k, m in enumerate((2654435761, 40503, 2246822519, 3266489917))]
        if not seen.intersection(keys):
            out.append(words)
        seen.update(keys)
    return out


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)

    def scorer(self):
        """Function from text to probability; it holds compressors, so it is made where it runs."""
        if not self.weights:
            return lambda text: 0.0
        plain, other = _compressor(self.ordinary), _compressor(self.toxic)
        weights = np.array(self.weights)
        return lambda text: float(1 / (1 + np.exp(-np.clip(_features(_words(text or ""), plain, other) @ weights, -30, 30))))


def _compressor(raw: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # Longer searches than the level's own, which reach the front of the dictionary, and no matches of a few bytes, which any text has.
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=18, hash_log=17, search_log=8, min_match=7, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def _features(words: list[str], plain, other) -> np.ndarray:
    saved = np.array([len(plain.compress(w + _TAIL)) - len(other.compress(w + _TAIL)) for w in _windows(words)] or [0])
    counts = [np.array([(sign * saved >= t).sum() for t in range(1, STEPS + 1)]) for sign in (1, -1)]
    return np.concatenate([[1.0, max(0, saved.max())], *[f for c in counts for f in (np.log1p(c), np.sqrt(c / len(saved)))]])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps, halved while they make the fit worse; the intercept is not shrunk."""
    shrink = ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (shrink * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink) + 1e-9 * np.eye(len(w)), x.T @ (weight * (y - p)) - shrink * w)
        before = loss(w)
        while np.abs(step).max() >= 1e-6 and loss(w + step) > before:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _train_dictionary(size: int, samples: list[bytes], segments: tuple[int, ...], d: int) -> bytes:
    """A trained dictionary: the fullest, as the trainer may give up early on small segments; of few samples, which
    it refuses, the distinct samples themselves."""
    import zstandard

    best = b""
    try:
        for k in segments:
            made = zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
            best = made if len(made) > len(best) else best
            if len(best) >= size:
                break
        return best
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _grams(words: list[str]) -> tuple[bytes, np.ndarray]:
    """The text of the words, and at each of its places a 32-bit hash of the next GRAM bytes."""
    text = f" {' '.join(words)} ".encode()
    x = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    n = max(0, len(x) - GRAM + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | x[k : k + n]
    return text, ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def _wanted(samples: list[list[list[str]]], lift: float, least: float, most: int = 8) -> list[np.ndarray]:
    """For each of two classes, the grams that enough of its documents have and that are ``lift`` times as frequent as in the other (at most
    ``most`` occurrences of a document count)."""
    own: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for texts in samples:
        counted = [np.unique(_grams(words)[1], return_counts=True) for words in texts]
        own.append([(k, np.minimum(n, most).astype(np.uint8)) for k, n in counted])
    places = [max(1, sum(int(n.sum()) for _, n in o)) for o in own]
    found: list[list[np.ndarray]] = [[], []]
    # The last bits part the grams evenly; a part is sorted at a time.
    for part in range(8):
        tables = []
        for o in own:
            mine = [(k[at], n[at]) for k, n in o for at in [(k & np.uint32(7)) == part]]
            keys, where = np.unique(np.concatenate([k for k, _ in mine]), return_inverse=True)
            tables.append((keys, np.bincount(where), np.bincount(where, weights=np.concatenate([n for _, n in mine]))))
        for y, ((keys, docs, times), (others, _, theirs)) in enumerate((tables, tables[::-1])):
            at = np.minimum(np.searchsorted(others, keys), max(0, len(others) - 1))
            there = np.where(others[at] == keys, theirs[at], 0) if len(others) else np.zeros(len(keys))
            found[y].append(keys[(docs >= max(2, least * len(samples[y]))) & (times / places[y] >= lift * (there + 0.5) / places[1 - y])])
    return [np.concatenate(f) for f in found]


def _distinctive(texts: list[list[str]], wanted: np.ndarray) -> list[bytes]:
    """The places of the texts that the wanted grams cover."""
    out = []
    for words in texts:
        text, h = _grams(words)
        begins = np.flatnonzero(np.isin(h, wanted))
        covered = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(covered, np.maximum(0, begins - MARGIN), 1)
        np.add.at(covered, np.minimum(len(text), begins + GRAM + MARGIN), -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(covered)[:-1] > 0, [0]]).astype(np.int8)))
        out += [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def _dictionaries(ordinary: list[list[str]], toxic: list[list[str]], lift: float, least: float) -> tuple[bytes, bytes]:
    windows = [w for t in ordinary for w in _windows(t)]
    # The trainer stops early where little repeats; text as it stands fills the part up.
    common = (b"".join(windows[: COMMON // WINDOW])[:COMMON] + _train_dictionary(COMMON, windows, (24,), 6))[-COMMON:]
    del windows
    # A document's places are one sample: the trainer counts in how many samples a string stands.
    places = [[b"".join(_distinctive([t], w)) for t in v] for v, w in zip((ordinary, toxic), _wanted([ordinary, toxic], lift, least), strict=True)]
    return tuple(_train_dictionary(OWN, [s for s in p if s], SEGMENTS, 6)[-OWN:].rjust(OWN, b"\0") + common for p in places)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 2000, lift: float = 10.0, least: float = 0.05) -> Model:
    """Dictionaries and calibration from the sample, the latter at the classes' true proportion.

    The sample is drawn among ``labels`` (id, label), in the order of a hash of the id; only its texts, whose ids fit in
    a broadcast of fixed size, are read from ``docs``.
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model()
    drawn = [rows.filter(F.col("y") == y).select("id", "y", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max_rows) for y in (0, 1)]
    text = F.col(text_col).cast("string")
    places = F.array_sort(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE)), lambda k: F.struct(F.xxhash64(k).alias("h"), k.alias("k"))))
    places = F.array_sort(F.transform(F.slice(places, 1, PIECES), lambda p: p["k"]))
    pieces = F.array_join(F.transform(places, lambda k: F.substring(text, (k * PIECE + 1).cast("int"), F.lit(PIECE))), "")
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), pieces.alias("text"))
    share = counts[1] / (counts[0] + counts[1])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted(row for batch in batches for row in zip(batch["h"], batch["text"], batch["y"], strict=True))
        model = fit_texts([t for _, t, y in found if y == 0], [t for _, t, y in found if y == 1], share, lift, least)
        yield pd.DataFrame({"ordinary": [model.ordinary], "toxic": [model.toxic], "weights": [model.weights]})

    # The bounded sample goes to one task, not to the driver.
    sample = texts.join(F.broadcast(drawn[0].union(drawn[1])), "id").select("h", "text", "y").repartition(1)
    made = sample.mapInPandas(learn, "ordinary binary, toxic binary, weights array<double>").collect()
    return Model(bytes(made[0]["ordinary"]), bytes(made[0]["toxic"]), list(made[0]["weights"])) if made else Model()


def fit_texts(ordinary_texts: list[str], toxic_texts: list[str], share: float, lift: float = 10.0, least: float = 0.05) -> Model:
    """The model of two lists of texts, where toxic ones make up ``share`` of the documents to come."""
    sample = [_unlike(ordinary_texts), _unlike(toxic_texts)]
    if min(map(len, sample)) < FOLDS:
        return Model()
    x, y = [], []
    for fold in range(FOLDS):
        plain, other = map(_compressor, _dictionaries(*[[t for k, t in enumerate(v) if k % FOLDS != fold] for v in sample], lift, least))
        for label, texts in enumerate(sample):
            x += [_features(t, plain, other) for t in texts[fold::FOLDS]]
            y += [label] * len(texts[fold::FOLDS])
    y = np.array(y, dtype=float)
    weight = np.where(y == 1, share / len(sample[1]), (1 - share) / len(sample[0])) * len(y)
    return Model(*_dictionaries(*sample, lift, least), _logistic(np.array(x), y, weight).tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for batch in batches:
            values = [scorer(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": values, "predicted": [int(v >= 0.5) for v in values]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that nothing is learned from; a null id counts as one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
