"""Media columns by signature sniffing: magic bytes are located, formats are validated, media are carved.

An Aho-Corasick automaton over all signatures passes once over each payload. At each place found, the format's
validator reads its header and says how long the medium is, or that it is none. What stands at offset 0 and holds
gives the type, whatever was declared; valid media further in are carved as (type, offset, length). A medium inside an
accepted one's range is part of that one unless it comes first.

Cases: a null payload has no type and no media; an empty payload likewise; a declared type that is null or wrong is
replaced; repeated rows repeat their result; other columns are kept (a clash with the result's names is refused);
an empty table gives no rows. Payloads of any length are read whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import table

ROW = 192  # bytes of a row of 64 RGB pixels

# File signatures, as their formats define them.
SIGNATURES = {b"BM": "image/bmp", b"RIFF": "audio/wav", b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"P5": "image/pgm", b"\xff\xd8\xff": "image/jpeg", b"%PDF-": "application/pdf"}


def _bmp(b: bytes, at: int) -> int:
    """The length of the valid medium at ``at``, or 0; so for all validators."""
    if len(b) < at + 54:
        return 0
    size, reserved, start, header, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    row = (abs(width) * depth + 31) // 32 * 4
    good = reserved == 0 and header == 40 and planes == 1 and depth in (8, 24, 32) and packed == 0 and width > 0 and height != 0 and start >= 54
    return size if good and size == start + row * abs(height) and at + size <= len(b) else 0


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 16] != b"WAVEfmt ":
        return 0
    size, (kind, channels, rate, per_s, block, bits) = struct.unpack_from("<I", b, at + 4)[0] + 8, struct.unpack_from("<HHIIHH", b, at + 20)
    good = kind == 1 and channels > 0 and block == channels * bits // 8 and per_s == rate * block and b[at + 36 : at + 40] == b"data"
    return size if good and struct.unpack_from("<I", b, at + 40)[0] + 44 == size and at + size <= len(b) else 0


def _png(b: bytes, at: int) -> int:
    place, first = at + 8, True
    while place + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, place)
        if first and (kind, n) != (b"IHDR", 13) or place + 12 + n > len(b) or zlib.crc32(b[place + 4 : place + 8 + n]) != struct.unpack_from(">I", b, place + 8 + n)[0]:
            return 0
        place, first = place + 12 + n, False
        if kind == b"IEND":
            return place - at
    return 0


def _pgm(b: bytes, at: int) -> int:
    fields = b[at : at + 40].split(None, 4)
    if len(fields) < 4 or not all(x.isdigit() and len(x) < 10 for x in fields[1:4]) or fields[3] != b"255":
        return 0
    head = b"P5\n%s %s\n255\n" % (fields[1], fields[2])
    size = len(head) + int(fields[1]) * int(fields[2])
    return size if size > len(head) and b[at : at + len(head)] == head and at + size <= len(b) else 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 14:
        return 0
    place = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while place < len(b):
        if b[place] == 0x3B:
            return place + 1 - at
        if b[place] == 0x21:
            place += 2
        elif b[place] == 0x2C and place + 10 < len(b):
            place += 11 + (3 << (b[place + 9] & 7) + 1 if b[place + 9] & 0x80 else 0)
        else:
            return 0
        while place < len(b) and b[place]:
            place += 1 + b[place]
        place += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF and b[place + 1] != 0xD9:
        kind, n = b[place + 1], struct.unpack_from(">H", b, place + 2)[0]
        if kind < 0xC0 or n < 2 or place + 2 + n > len(b):
            return 0
        place += 2 + n
        if kind == 0xDA:  # the coded data end at the next marker that is none of 00 and D0 to D7
            while (place := b.find(b"\xff", place)) >= 0 and place + 1 < len(b) and (b[place + 1] == 0 or 0xD0 <= b[place + 1] <= 0xD7):
                place += 2
            if place < 0:
                return 0
    return place + 2 - at if b[place : place + 2] == b"\xff\xd9" and place > at + 2 else 0


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at) if b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"." else -1
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


VALIDATORS: dict[str, Callable[[bytes, int], int]] = {"image/bmp": _bmp, "audio/wav": _wav, "image/png": _png, "image/pgm": _pgm, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        out.add_word(magic.decode("latin-1"), (len(magic), kind))
    out.make_automaton()
    return out


def carve(data: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """The valid media of a payload, from left to right, none inside another."""
    found, free = [], 0
    for last, (n, kind) in sorted(machine.iter(data.decode("latin-1")), key=lambda x: x[0] - x[1][0]):
        at = last + 1 - n
        if at >= free and (size := VALIDATORS[kind](data, at)):
            found.append((kind, at, size))
            free = at + size
    return found


MEDIA = T.StructType([T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("media", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])))])


def _mapped(docs: DataFrame, added: T.StructType, make: Callable[[], Callable[[dict], tuple]], step: int = 200) -> DataFrame:
    """docs with more columns, made row by row from the row; make is called in each task."""
    if clash := {*docs.columns} & {*added.names}:
        raise ValueError(f"docs has columns {sorted(clash)}")
    kinds = [pa.field(f.name, _arrow(f.dataType)) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                rows = [one(row) for row in some.to_pylist()]
                more = [pa.array([r[i] for r in rows], k.type) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*some.columns, *more], [*some.schema.names, *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {T.StringType: pa.string(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}[type(kind)]


def sniff(rows: DataFrame, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """Adds media_type, corrected (the declared type was another) and media (type, offset, length) to rows."""

    def make() -> Callable[[dict], tuple]:
        machine = automaton()

        def one(row: dict) -> tuple:
            media = carve(row[content] or b"", machine)
            kind = media[0][0] if media and media[0][1] == 0 else None
            return kind, kind is not None and kind != row[declared], [{"type": k, "offset": a, "length": n} for k, a, n in media]

        return one

    return _mapped(rows, MEDIA, make)


def as_bmp(payload: bytes) -> bytes:
    """Bytes as the samples of 24-bit rows, 64 pixels wide, stored from top to bottom."""
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(payload), 0, 54, 40, ROW // 3, -(len(payload) // ROW), 1, 24, 0, len(payload), 2835, 2835, 0, 0)
    return head + payload


def as_wav(payload: bytes, rate: int = 8000) -> bytes:
    return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVEfmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def as_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def samples(kind: str, medium: bytes) -> bytes:
    """The sample bytes of a stored medium of the three kinds written here, by its own header."""
    if kind == "image/bmp":
        return medium[struct.unpack_from("<I", medium, 10)[0] :]
    return medium[44:] if kind == "audio/wav" else medium[medium.index(b"\n255\n") + 5 :]


STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("declared_type", T.StringType())])


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts as media: UTF-8 bytes, padded by spaces to a positive multiple of 192, as samples of a bitmap, sound or
    grey map, chosen by the payload's checksum. The declared type says nothing, as in a crawl."""

    def make() -> Callable[[dict], tuple]:
        writers = (as_bmp, as_wav, as_pgm)

        def one(row: dict) -> tuple:
            data = (row[text] or "").encode()
            payload = data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))
            return len(data), writers[zlib.crc32(payload) % 3](payload), "application/octet-stream"

        return one

    return _mapped(docs, STORED, make)


READ = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])


def read_back(rows: DataFrame, content: str = "content") -> DataFrame:
    """From sniffed rows: payload, the samples of the first carved medium, and a feature of them (type, count, mean,
    deviation, and the share of the most frequent sample, all by numpy over the samples). Null without a medium."""

    def make() -> Callable[[dict], tuple]:
        def one(row: dict) -> tuple:
            if not row["media"] or row["media"][0]["type"] not in ("image/bmp", "audio/wav", "image/pgm"):
                return None, None
            first = row["media"][0]
            payload = samples(first["type"], row[content][first["offset"] : first["offset"] + first["length"]])
            counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            mean = counts @ np.arange(256) / len(payload)
            spread = (counts @ (np.arange(256) - mean) ** 2 / len(payload)) ** 0.5
            return payload, f"{first['type']};n={len(payload)};mean={mean:.4f};sd={spread:.4f};mode={counts.argmax()}:{counts.max() / len(payload):.4f}"

        return one

    return _mapped(rows, READ, make)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    out = read_back(sniff(store_texts(docs).drop("text")))
    tail = F.crc32(F.substring("payload", -16, 16))
    return out.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256"), "feature", "media_type", "corrected")
