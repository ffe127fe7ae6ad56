"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. The encodings of all prefixes of a byte string form a tree: the last token of a prefix is the one vocabulary
token that ends there and is compatible with the last token of the prefix before it, where a pair is compatible if the
merges leave the two tokens apart. The transducer follows every place from which a token may still reach beyond the
bytes read. Its state is that set of places, each with its node in the trie of tokens, the token before it and the
output not yet emitted; output common to all of them is emitted at once (determinisation with residual outputs), so the
lookahead is bounded by the longest token. States and transitions are made when first needed, and a bounded number kept.

Decoding. Tokens move a UTF-8 state machine forward, which says how much of an unfinished character is to be held back,
so that text can be emitted while ids arrive.

Cases: a null text is an empty one, with no ids; repeated rows repeat their result; very long texts run through the same
states; an empty table gives no rows; other columns are kept as they are (a clash with the result's names is refused).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.chunks import Memo
from tidewell.llm.common import table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges taken one by one, lowest rank first, leftmost first: for pairs of tokens and tests."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [ranks.get(a + b, 1 << 60) for a, b in pairwise(parts)]
        rank = min(found)
        if rank == 1 << 60:
            break
        at = found.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """limit: transitions that are kept. Once there are so many, others are made when they are needed and not kept, so
    memory is bounded and the common beginnings of words stay."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 250_000):
        self.ranks, self.limit, self.token = ranks, limit, {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = node << 8 | byte
                if step not in self.child:
                    self.child[step] = len(self.ends)
                    self.ends.append(-1)
                node = self.child[step]
            self.ends[node] = rank
        self.inner = {step >> 8 for step in self.child}
        self.apart: dict[int, bool] = {}
        self.made, self.number = 0, {}
        self.start = self._state(((0, -1, ()),))

    def _state(self, places: tuple) -> dict:
        """A state is a dict: byte to (next state, what is emitted), -1 to what is emitted at the end, -2 to its places."""
        state = self.number.get(places)
        if state is None:
            state = {-1: places[-1][2], -2: places}
            if self.made < self.limit:
                self.number[places] = state
        return state

    def compatible(self, before: int, token: int) -> bool:
        """Whether the merges leave the two apart; whether they make the token, if none is before it."""
        pair = before + 1 << 32 | token
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > self.limit:
                self.apart.clear()
            own = self.token[token]
            if before < 0:
                known = merged(own, self.ranks) == [token]
            else:
                whole = self.token[before] + own
                known = whole not in self.ranks and merged(whole, self.ranks) == [before, token]
            self.apart[pair] = known
        return known

    def move(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The next state and what is emitted. Places that no token leaves are given up."""
        alive, last = [], None
        child, ends = self.child, self.ends
        for node, before, held in state[-2]:
            node = child.get(node << 8 | byte)
            if node is not None:
                token = ends[node]
                if node in self.inner:
                    alive.append((node, before, held))
                if last is None and token >= 0 and self.compatible(before, token):
                    last = (0, token, (*held, token))
        shared, first = 0, last[2]
        for _, _, held in alive:
            if not held:
                break
        else:
            while all(len(h) > shared and h[shared] == first[shared] for _, _, h in alive) and len(first) > shared:
                shared += 1
        if shared:
            places = (*[(node, before, out[shared:]) for node, before, out in alive], (0, last[1], first[shared:]))
        else:
            places = (*alive, last)
        out = (self._state(places), first[:shared])
        if self.made < self.limit:
            self.made += 1
            state[byte] = out
        return out

    def run(self, data: bytes) -> list[int]:
        state, out = self.start, []
        for byte in data:
            state, emitted = state.get(byte) or self.move(state, byte)
            if emitted:
                out += emitted
        return [*out, *state[-1]]


class Encoder:
    """Encodes texts: each match of the pattern by itself; a match that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 600_000):
        self.ranks, self.machine = ranks, Transducer(ranks)
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.memo = Memo(self.pattern.findall, self.piece, lambda word: self.piece(" " + word), limit=memo)

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.ranks.get(data)
        return array("i", self.machine.run(data) if rank is None else (rank,)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        return b"".join(self.memo.values(text))


@lru_cache(maxsize=2)
def worker_encoder(ranks_path: str, pattern: str, memo: int) -> Encoder:
    """One for each Python worker, so that what a task has learned serves the next ones."""
    return Encoder(read_ranks(ranks_path), pattern, memo)


# Fixed values of UTF-8: first bytes, how many bytes follow, and what the next of them may be.
_FIRST = (
    (0x00, 0x7F, 0, 0x80, 0xBF),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)


class Utf8Machine:
    """Reads bytes forward. A state is (bytes read of a character, bytes to come, least and greatest next byte)."""

    START = (0, 0, 0x80, 0xBF)

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes, self.known = token_bytes, {}
        self.begins = {b: (1, n, low, high) if n else self.START for first, last, n, low, high in _FIRST for b in range(first, last + 1)}
        #: after a token that begins a character and ends one the state is START, whatever it was before
        self.settles = np.array([bool(t) and t[0] in self.begins and self.through(self.START, t) == self.START for t in token_bytes], bool)

    def through(self, state: tuple, data: bytes) -> tuple:
        for byte in data:
            read, more, low, high = state
            if more and low <= byte <= high:
                state = (read + 1, more - 1, 0x80, 0xBF) if more > 1 else self.START
            else:  # a byte that nothing can have begins anew, or stands by itself
                state = self.begins.get(byte, self.START)
        return state

    def step(self, state: tuple, token: int) -> tuple:
        if (state, token) not in self.known:
            self.known[state, token] = self.through(state, self.token_bytes[token])
        return self.known[state, token]

    def after(self, state: tuple, ids: np.ndarray) -> tuple:
        """The state after all ids: from the last one that settles it."""
        settled = np.nonzero(self.settles[ids])[0]
        if len(settled):
            state, ids = self.START, ids[settled[-1] + 1 :]
        for token in ids.tolist():
            state = self.step(state, token)
        return state


class StreamingDecoder:
    """Text for ids as they come, holding back an unfinished character; bytes that no text can have become U+FFFD."""

    def __init__(self, machine: Utf8Machine):
        self.machine, self.state, self.held = machine, machine.START, b""

    def feed(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        data = self.held + b"".join(map(self.machine.token_bytes.__getitem__, ids.tolist()))
        self.state = self.machine.after(self.state, ids)
        whole = len(data) - self.state[0]
        self.held = data[whole:]
        return data[:whole].decode(errors="replace")

    def close(self) -> str:
        data, self.held, self.state = self.held, b"", self.machine.START
        return data.decode(errors="replace")


@lru_cache(maxsize=2)
def utf8_machine(ranks_path: str) -> Utf8Machine:
    ranks = read_ranks(ranks_path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return Utf8Machine(out)


def encoded(encoder: Encoder, texts: list[str | None]) -> pa.ListArray:
    made = [encoder.encode(x or "") for x in texts]
    ends = np.cumsum([0, *(len(x) // 4 for x in made)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), np.int32)))


def decoded_texts(machine: Utf8Machine, ids: pa.ListArray, step: int) -> pa.Array:
    """UTF-8 bytes; ids are fed to the streaming decoder in runs of ``step``."""
    ends, flat, out = ids.offsets.to_numpy(), ids.values.to_numpy(), []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        decoder = StreamingDecoder(machine)
        out.append("".join([decoder.feed(flat[i : min(i + step, b)]) for i in range(a, b, step)] + [decoder.close()]).encode())
    return pa.array(out, pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids", memo: int = 600_000, decoded: str | None = None, step: int = 4096) -> DataFrame:
    """Adds a column of ids (array<int>) to docs, and if ``decoded`` is a name also their text, as :func:`decode` does."""
    names = [ids, *([decoded] if decoded else [])]
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"docs has columns {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks_path, pattern, memo)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                made = [encoded(encoder, some.column(some.schema.get_field_index(text)).to_pylist())]
                if decoded:
                    made.append(decoded_texts(utf8_machine(ranks_path), made[0], step))
                yield pa.RecordBatch.from_arrays([*some.columns, *made], [*some.schema.names, *names])

    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", step: int = 4096) -> DataFrame:
    """Adds the text of the ids as UTF-8 bytes."""

    def text(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in column:
            yield decoded_texts(utf8_machine(ranks_path), rows, step)

    return docs.withColumn(decoded, F.arrow_udf(text, "binary")(F.col(ids)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
