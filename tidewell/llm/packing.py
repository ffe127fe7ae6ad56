"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, longest first.

A document of n tokens gives n // longest pieces of the longest length, then one piece for each set bit of the rest.
Every piece is a sequence by itself, so no sequence crosses documents and none needs padding; pieces of equal length
share a bucket, from which a trainer draws batches. Nothing is shuffled: pieces leave the task that tokenized them.

Cases: a null or empty text has the end token alone; a null doc_id is kept; repeated rows give their own sequences;
very long texts give many longest pieces; an empty table gives no rows; further columns are not read. A special
token's string inside a text is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.chunks import Memo
from tidewell.llm.common import table

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def decompose(n: int, longest: int = 1024) -> list[int]:
    """The lengths for n tokens; longest is a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


#: How byte-level BPE cuts texts of plain characters: ASCII but for control characters, and Latin letters with marks.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf"[\t\n\x20-\x7e{_LETTER}]*")


def byte_level_pieces(text: str) -> list[str] | None:
    """The pre-tokens of plain text; None of other text, which the library cuts itself."""
    return _PIECES.findall(text) if _PLAIN.fullmatch(text) else None


def byte_names() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others, in order, from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(tokenizer: str, memo: int) -> Memo:
    """One for each Python worker, so that what a task has learned serves the next ones. Tokenizers whose pre-tokens are
    not known to be those of byte-level BPE encode whole parts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True
    spec = json.loads(model.to_str())
    bare, kind = model.model, spec["pre_tokenizer"] or {}
    known = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
    added = [t["content"] for t in spec["added_tokens"] if not t["special"]]
    many = lambda texts: [array("I", x.ids).tobytes() for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    names, tokenize = byte_names(), bare.tokenize

    def word(letters: str) -> bytes:
        return array("I", [t.id for t in tokenize(names[32] + letters)]).tobytes()

    def one(piece: str) -> bytes:
        return array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(names))]).tobytes()

    if not known or added:
        return Memo(lambda _: None, one, lambda letters: many([" " + letters])[0], many, memo)
    return Memo(byte_level_pieces, one, word, many, memo)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = 1024, memo: int = 600_000) -> DataFrame:
    """From docs(doc_id, text): a row for each piece, ids as little-endian unsigned 32-bit integers, with its bucket
    (log2 of the length), sequence_id and offset. Ids of sequences come from the partition and the place in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer, memo), array("I", [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, rows = batch.slice(at, 500), ([], [], [], [], [])
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = b"".join([*known.values(text or ""), end])
                    n, start = len(ids) // 4, 0
                    for length in decompose(n, longest):
                        for column, value in zip(rows, (doc_id, start, length, ids[4 * start : 4 * (start + length)], n), strict=True):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a trainer reads whole batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
