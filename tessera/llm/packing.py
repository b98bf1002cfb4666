"""Packing by power-of-two decomposition.

Every document is tokenized, ended by an end token, and cut into pieces whose lengths are powers of two: as many pieces
of ``max_tokens`` as fit, then the binary digits of the rest from the highest down. A piece is a sequence of its own, so
that none crosses a document and none needs padding; equal lengths share a ``bucket`` (the exponent), from which a
trainer draws batches of one shape. Nothing is shuffled: a piece depends on its document alone, and its sequence id is
its place in its task's output, which a retried task makes again.

Defined results: a null or empty text is one piece with the end token only; repeated rows are packed once for each row;
a null doc_id stays null; other columns of the input are ignored. Texts are tokenized some 4 MB at a time, so that what
stands in them many times is looked up once; a longer text goes alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text outside of this goes to the tokenizer whole. Inside of it the word split below equals the tokenizer's own, and
#: lower case is one character to one; control characters, combining marks and special tokens are outside.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž‐-‧‰-⁞€]*")
#: The pre-tokenizer's pattern in the vocabulary file, over the characters of _PLAIN.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: A piece that is one word, or one and then only these, needs no pattern.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are tokenized together.
_TOGETHER = 4 << 20
#: The normalizer, pre-tokenizer and word end that a vocabulary file must have for the word-wise path.
_WORD_WISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "word_end": "</w>",
}
PIECES = "doc_id long, start long, length long, bucket int, doc_tokens long, ids binary"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(other)}


class WordTokens(dict):
    """Word to its token ids as little-endian unsigned 32-bit.

    A word that is not there yet is merged by a rank-based byte-pair encoder, where its bytes have a symbol there, and
    else by the tokenizer; the table starts anew when full. Merging by the rank of the joined bytes equals merging by
    the rank of the pair if every joined token, merged alone by its pairs, becomes itself: ``ranks`` leaves this
    encoder out when one token of the vocabulary does not.
    """

    def __init__(self, tokenizer, ranks: dict[bytes, int] | None, ids: dict[bytes, int] | None, most: int = 150_000) -> None:
        super().__init__()
        self.tokenizer, self.most, self.merger = tokenizer, most, None
        if ranks:
            import tiktoken

            order = list(ranks)
            self.merger = tiktoken.Encoding("words", pat_str=".", mergeable_ranks={t: k for k, t in enumerate(order)}, special_tokens={})._core_bpe
            self.ids = [ids[t].to_bytes(4, "little") for t in order]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        raw = word.encode()
        if self.merger and not raw.translate(None, _INNER_BYTES):
            found = b"".join([self.ids[k] for k in self.merger.encode_single_piece(raw[:-1].translate(_INNER) + raw[-1:].translate(_LAST))])
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= 64:
            self[word] = found
        return found

    def piece(self, piece: str) -> bytes:
        """Of a piece of lower-case ordinary text without white space: words, digits and marks in a row."""
        if piece.isalpha():
            return self[piece]
        word = piece.rstrip(_MARKS)
        if word.isalpha():
            return self[word] + self[piece[len(word) :]]
        return b"".join(map(self.__getitem__, _WORD.findall(piece)))


#: One-byte symbols for the bytes that lower-case western text has: inside of a word, and at its end.
_INNER_BYTES = bytes([*range(0x21, 0x41), *range(0x5B, 0x7F), 0xC3, *range(0x9F, 0xC0)])
_INNER = bytes.maketrans(_INNER_BYTES, bytes(range(len(_INNER_BYTES))))
_LAST = bytes.maketrans(_INNER_BYTES, bytes(range(len(_INNER_BYTES), 2 * len(_INNER_BYTES))))


def ranks(tokenizer_path: str) -> tuple[dict[bytes, int], dict[bytes, int]] | None:
    """Ranks and ids of the tokens in one-byte symbols, or None where the word-wise path would not be exact."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    if spec["normalizer"] != _WORD_WISE["normalizer"] or split != [_WORD_WISE["split"]] or model.get("end_of_word_suffix") != _WORD_WISE["word_end"]:
        return None
    letters, inner, end = _byte_letters(), set(_INNER_BYTES), _WORD_WISE["word_end"]

    def symbols(token: str) -> bytes | None:
        last = token.endswith(end) and token != end
        raw = bytes(letters[c] for c in (token[: -len(end)] if last else token)) if token else b""
        if not raw or set(raw) - inner:
            return None
        return raw[:-1].translate(_INNER) + raw[-1:].translate(_LAST) if last else raw.translate(_INNER)

    pairs: dict[tuple[bytes, bytes], int] = {}
    order: dict[bytes, int] = {}
    ids: dict[bytes, int] = {}
    for b in _INNER_BYTES:
        letter = next(c for c, v in letters.items() if v == b)
        for token in (letter, letter + end):
            ids[symbols(token)] = model["vocab"][token]
            order[symbols(token)] = len(order)
    for k, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        token = symbols(left + right)
        if token is not None:
            a, b = symbols(left), symbols(right)
            pairs[a, b] = k
            if token in ids:
                return None
            ids[token], order[token] = model["vocab"][left + right], len(order)
    for token in order:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min(((pairs.get((a, b), len(pairs) * 99), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank == len(pairs) * 99:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return order, ids


def _ordinary(texts: pa.Array, words: WordTokens) -> Iterator[bytes]:
    """The ids of ordinary texts: these are split at white space, and each different piece is looked up once."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    bounds, pieces = split.offsets.to_numpy(), split.flatten().dictionary_encode()
    del split
    # One string and its split: a list of strings by way of Arrow's scalars takes six times as long.
    different = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), " ")[0].as_py().split(" ") if len(pieces) else []
    found = pa.array(map(words.piece, different), pa.large_binary())
    del different
    ids = found.take(pieces.indices)
    del found, pieces
    bounds, raw = np.frombuffer(ids.buffers()[1], "<i8")[bounds].tolist(), memoryview(ids.buffers()[2] or b"")
    return (bytes(raw[start:end]) for start, end in zip(bounds, bounds[1:], strict=False))


def encode_all(texts: pa.Array, tokenizer, words: WordTokens) -> Iterator[bytes]:
    """The ids that ``tokenizer`` gives each text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="i8")
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")))
        part, at = texts.slice(at, to - at), to
        plain = [words.merger is not None and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in (text.as_py() for text in part)]
        ordinary = _ordinary(part.filter(pa.array(plain, pa.bool_())), words) if any(plain) else iter(())
        for text, own in zip(part, plain, strict=True):
            yield next(ordinary) if own else np.array(tokenizer.encode(text.as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()


def encode(text: str, tokenizer, words: WordTokens) -> bytes:
    """The ids that ``tokenizer`` gives ``text``."""
    return next(encode_all(pa.array([text]), tokenizer, words))


def lengths(n: int, most: int) -> list[int]:
    """n as pieces of ``most`` and then falling powers of two."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their token ids (``ids``: little-endian unsigned 32-bit), sequence_id and offset (always 0)."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    table, end = ranks(tokenizer_path), int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        words = WordTokens(tokenizer, *(table or (None, None)))
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).fill_null(""), tokenizer, words), strict=True):
                raw, at = raw + end, 0
                total = len(raw) // 4
                for n in lengths(total, max_tokens):
                    for column, value in zip(out, (doc_id, at, n, n.bit_length() - 1, total, raw[4 * at : 4 * (at + n)]), strict=True):
                        column.append(value)
                    at += n
                    held += 4 * n
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                        out, held = [[], [], [], [], [], []], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def batches(pieces: DataFrame, bucket: int) -> DataFrame:
    """The sequences of one length, for a trainer that wants one shape."""
    return pieces.filter(F.col("bucket") == bucket)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
