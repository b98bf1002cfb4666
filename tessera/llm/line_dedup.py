"""Line dedup by content-defined line chunks.

A text is a sequence of lines. A hash rolls over the hashes of the last ``window`` lines, and a chunk may end after every
line where it falls into one of ``divisor`` classes. It ends there if the lines since the last such line are two at least and have
``min_words`` words, whether or not a chunk ended at that one. So boundaries depend on the lines near them alone, and an inserted
or removed line moves no boundary but its neighbours'. A line of more than ``long_line`` words is a chunk of its own
and also ends the chunk before it, so that a passage in one line is found whatever stands around it; ``max_lines`` bounds
a chunk. All chunks are compared over all documents, but for rests of one line or fewer than ``min_words`` words in front of a long
line or the end of the text.

With ``passages`` (as in the query and the pipeline), every match is carried beyond its chunk, as passages are compared
too: from each line on, the fewest lines that have more than ``long_line`` words in all, and the same backwards from each
line. Whatever run of lines of more than ``long_line`` words stands in a row in an earlier document as well is covered by
such passages that both have, up to its first and last line, and nothing beyond it is; so it goes whole wherever the
chunks are cut. No chunk is left to passages: all are compared, with passages or without. Without them only chunks are removed.

Chunks and passages are ranges of lines, and are compared in two steps. By hash: a row for each distinct range of a
document has its 128-bit hash and the document; hashes that two documents have are the repeated ones. By bytes: ranges of
repeated hashes, and no others, are shuffled with their bytes and grouped by both, and a document loses a range only if
its bytes are those of an earlier document's. Which ranges those are is asked of a bit map of fixed size at most, which lets some
others through but holds none back. A hash of one text stands for it from there on; where several texts have one hash,
these texts themselves are joined. Overlapping passages repeat bytes: of a repeated text of lines of n words, about 2 * ``long_line`` / n times
its size is shuffled.

A group that more than one document has is kept in the document with the smallest id and removed from all others. A repeat
inside of one document is removed on the spot, where both texts are at hand (a passage that overlaps the first one stays). Groups are combined before the shuffle, so
a chunk that a third of all documents has costs one row for each task, and the joins have small rows on one side, which
adaptive execution splits.

Defined results: null and empty texts have no chunk and come back unchanged; rows that repeat a doc_id count as one
document (all keep what is first seen there; what other documents have goes from the text that has it), and a null doc_id counts as the smallest; other columns of the input come
back as they are, whatever their names; an empty table gives no rows; texts of any length are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

LEAST_ID = -(1 << 63)
#: The column that dedup() adds.
REPORT = "line_dedup_report"
#: Bytes of ranges after which a batch of them is sent on.
BATCH_BYTES = 8 << 20
#: Bits of the map of repeated hashes at most, as a power of two (16 MB). A fuller map only lets more ranges through.
MAP_BITS = 27


@dataclass(frozen=True)
class Chunking:
    window: int = 2
    divisor: int = 2
    long_line: int = 50
    min_words: int = 12
    max_lines: int = 64
    passages: bool = False
    #: Of a range's hash; fewer than 128 only make texts share one more often.
    bits: int = 128

    def chunks(self, text: str) -> list[tuple[int, int, bool]]:
        """(first line, line after the last, whether it is compared), covering all lines in order."""
        return self._cut(text.encode("utf-8", "surrogatepass").split(b"\n"), _words(text))

    def _cut(self, lines: list[bytes], words: list[int]) -> list[tuple[int, int, bool]]:
        import xxhash

        out, start, inside, rolled, since, said = [], 0, 0, 0, 0, 0
        hashes = [xxhash.xxh64_intdigest(line) for line in lines]
        factor, leaving = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, self.window, 1 << 64)

        def close(end: int) -> None:
            if end > start:
                out.append((start, end, end - start >= 2 and inside >= self.min_words))

        for k, n in enumerate(words):
            rolled = rolled * factor + hashes[k]
            if k >= self.window:
                rolled -= hashes[k - self.window] * leaving
            rolled &= 0xFFFFFFFFFFFFFFFF
            if n > self.long_line:
                close(k)
                out.append((k, k + 1, True))
                start, inside, since, said = k + 1, 0, 0, 0
                continue
            inside, since, said = inside + n, since + 1, said + n
            hit = (rolled >> 17) % self.divisor == 0
            if (hit and since >= 2 and said >= self.min_words) or k + 1 - start >= self.max_lines:
                close(k + 1)
                start, inside = k + 1, 0
            if hit:
                since, said = 0, 0
        close(len(words))
        return out

    def _windows(self, words: list[int]) -> list[tuple[int, int]]:
        """(first line, line after the last) of the fewest lines of more than ``long_line`` words from each line on, and
        backwards from each line, in order."""
        until = list(accumulate(words, initial=0))
        if until[-1] <= self.long_line:
            return []
        ranges, end = set(), 0
        for a in range(len(words)):
            while end <= len(words) and until[end] - until[a] <= self.long_line:
                end += 1
            if end > len(words):
                break
            ranges.add((a, end))
        start = 0
        for b in range(1, len(words) + 1):
            while until[b] - until[start + 1] > self.long_line:
                start += 1
            if until[b] - until[start] > self.long_line:
                ranges.add((start, b))
        return sorted(ranges)

    def ranges(self, text: str) -> tuple[bytes, list[int], list[tuple[int, int]], list[tuple[int, int]]]:
        """The text's bytes, where its lines start there, the compared chunks and the passages as (first line, line after the last)."""
        data, words = text.encode("utf-8", "surrogatepass"), _words(text)
        lines = data.split(b"\n")
        starts = list(accumulate((len(line) + 1 for line in lines), initial=0))
        chunks = [(a, b) for a, b, is_compared in self._cut(lines, words) if is_compared]
        return data, starts, chunks, self._windows(words) if self.passages else []

    def lost(self, text: str, hashes: set[bytes], texts: set[bytes]) -> set[int]:
        """The lines that go: those of chunks and passages that ``hashes`` or ``texts`` name, and of repeats."""
        import xxhash

        data, starts, chunks, passages = self.ranges(text)
        drop: set[int] = set()
        for ranges in (chunks, passages):
            had: dict[bytes, tuple[int, int]] = {}
            for a, b in ranges:
                part = data[starts[a] : starts[b] - 1]
                digest = xxhash.xxh3_128_digest(part)
                c, d = had.setdefault(digest, (a, b))
                if c != a and data[starts[c] : starts[d] - 1] != part:
                    c, d = had.setdefault(part, (a, b))
                if (c != a and (ranges is chunks or d <= a)) or (hashes and _short(digest, self.bits) in hashes) or (texts and part in texts):
                    drop.update(range(a, b))
        return drop


def _words(text: str) -> list[int]:
    return [len(line.split()) for line in text.split("\n")]


def _short(digest: bytes, bits: int) -> bytes:
    return digest if bits == 128 else (int.from_bytes(digest, "big") >> (128 - bits) << (128 - bits)).to_bytes(16, "big")


def _key(df: DataFrame, id_col: str):
    return F.coalesce(df[id_col].cast("long"), F.lit(LEAST_ID))


def _rows(docs: DataFrame, how: Chunking, repeated=None, texts: bool = False) -> DataFrame:
    """A row for each distinct compared range of a document: doc, its hash and, with ``texts``, its bytes; of those in the
    map ``repeated`` (a broadcast) only, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids, digests, parts = [], [], []

        def sent() -> pa.RecordBatch:
            h1, h2 = np.frombuffer(b"".join(digests), ">i8").astype("i8").reshape(-1, 2).T
            columns = [pa.array(ids, pa.int64()), pa.array(h1), pa.array(h2), *([pa.array(parts, pa.binary())] if texts else [])]
            if repeated is not None:
                kept = pa.array(_in_map(repeated.value, h1) & _in_map(repeated.value, h2))
                columns = [c.filter(kept) for c in columns]
            ids.clear(), digests.clear(), parts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc", "h1", "h2", *(["text"] if texts else [])])

        for batch in batches:
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, starts, chunks, passages = how.ranges(text.as_py())
                had: dict[bytes, tuple[int, int]] = {}
                for a, b in (*chunks, *passages):
                    part = data[starts[a] : starts[b] - 1]
                    digest = xxhash.xxh3_128_digest(part)
                    if digest in had and (not texts or data[slice(*had[digest])] == part):
                        continue
                    had.setdefault(digest, (starts[a], starts[b] - 1))
                    ids.append(doc)
                    digests.append(_short(digest, how.bits))
                    if texts:
                        parts.append(part)
                        size += len(part)
                        if size > BATCH_BYTES:
                            yield sent()
                            size = 0
            yield sent()

    rows = docs.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc", "text")
    return rows.mapInArrow(run, "doc long, h1 long, h2 long" + ", text binary" * texts)


def _in_map(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & (len(words) * 64 - 1)
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1


def _map(repeated: DataFrame) -> np.ndarray:
    """Bits for the hashes of ``repeated``, two for each, as 64-bit words."""
    size = 1 << max(16, min(MAP_BITS, (8 * repeated.count()).bit_length()))
    bits = repeated.select(F.explode(F.array(*[F.col(h).bitwiseAND(F.lit(size - 1)) for h in ("h1", "h2")])).alias("bit"))
    found = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(size // 64, "i8")
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def groups(rows: DataFrame, how: Chunking, repeated) -> DataFrame:
    """(h1, h2, text, first, last): the ranges in the map ``repeated`` by hash and bytes, with the least and the greatest document that has them."""
    return _rows(rows, how, repeated, texts=True).groupBy("h1", "h2", "text").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))


def removals(docs: DataFrame, how: Chunking | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, hashes, texts): what each document loses to a document with a smaller id; ``texts`` where a hash has several."""
    how, scratch = how or Chunking(), Scratch(docs.sparkSession)
    rows = docs.select(_key(docs, id_col).alias("doc"), docs[text_col].cast("string").alias("text"))
    ends = _rows(rows, how).groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = docs.sparkSession.sparkContext.broadcast(_map(scratch.write(ends.filter("first <> last").select("h1", "h2"), "repeated")))
    hashes = groups(rows, how, repeated).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"))
    compared = scratch.write(hashes.filter("first <> last").select("h1", "h2", "first", "texts"), "compared")
    found = _rows(rows, how, repeated).join(compared.filter("texts = 1"), ["h1", "h2"]).filter("doc <> first")
    lost = found.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("hashes"))
    # A hash of several texts says nothing of who has which: there, the texts themselves are joined.
    shared = compared.filter("texts > 1").select("h1", "h2")
    if shared.isEmpty():
        return lost.withColumn("texts", F.lit(None).cast("array<binary>"))
    apart = groups(rows, how, repeated).join(shared, ["h1", "h2"], "left_semi").filter("first <> last").select("h1", "h2", "text", "first")
    told = _rows(rows, how, repeated, texts=True).join(apart, ["h1", "h2", "text"]).filter("doc <> first")
    return lost.join(told.groupBy("doc").agg(F.collect_set("text").alias("texts")), "doc", "full")


def dedup(docs: DataFrame, how: Chunking | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, the text without what is repeated, and n_lines, n_lines_removed beside them in the struct REPORT."""
    how = how or Chunking()
    lost = removals(docs, how, id_col, text_col)
    kept = [c for c in docs.columns if c != text_col]
    carried = docs.select(_key(docs, id_col).alias("doc"), docs[text_col].cast("string").alias("text"), F.struct(*[docs[c] for c in kept]).alias("row"))
    joined = carried.join(lost, "doc", "left").select("text", "hashes", "texts", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_texts, total, gone, at = [], [], [], 0
            pairs = batch.column(1).flatten()
            names = np.stack([pairs.field(h).to_numpy() for h in ("h1", "h2")], 1).astype(">i8").tobytes()
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()
            for text, n, texts in zip(batch.column(0).to_pylist(), counts, batch.column(2).to_pylist(), strict=True):
                hashes = {names[16 * k : 16 * k + 16] for k in range(at, at + n)}
                at += n
                if not text:
                    kept_texts.append(text)
                    total.append(0)
                    gone.append(0)
                    continue
                lines, drop = text.split("\n"), how.lost(text, hashes, set(texts or ()))
                kept_texts.append("\n".join(line for k, line in enumerate(lines) if k not in drop) if drop else text)
                total.append(len(lines))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([pa.array(kept_texts, pa.string()), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), batch.column(3)], names=["text", "n_lines", "n_lines_removed", "row"])

    row_type = joined.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(run, f"text string, n_lines int, n_lines_removed int, row {row_type}")
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*columns, F.struct("n_lines", "n_lines_removed").alias(REPORT))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup(docs, Chunking(passages=True))
    return done.select("doc_id", F.col(f"{REPORT}.n_lines").alias("n_lines"), F.col(f"{REPORT}.n_lines_removed").alias("n_lines_removed"), F.length("text").alias("kept_chars"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))
