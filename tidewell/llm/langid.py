"""Language ID by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed byte n-grams says which of two sets
of languages a text belongs to; a text goes to the language whose codeword has the least loss, where each bit's
logistic loss counts by that bit's accuracy on the rows it was fitted to. A text whose two best languages lie close
together is flagged as ambiguous.

The classifiers are fitted to at most ``per_language`` labelled texts of each language (a bounded sample, drawn by a
hash of doc_id); counts of labels and predictions cover all rows and whole texts.

Cases: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; rows without a label are not
learned from; without any labelled row all texts are ``und``; a null doc_id is in no fold and not learned from;
repeated rows repeat their result; very long texts are read in blocks of a fixed size; other columns are kept (a clash
with the result's names is refused); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import table

SIZE = 4096  # hashed features
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(texts: list[str], block: int = 1 << 22) -> np.ndarray:
    """A row for each text: square roots of the shares of its byte pairs and triples, hashed. Letters only, A-Z folded."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for i, text in enumerate(texts):
        data = text.encode(errors="replace")
        for at in range(0, len(data), block):
            one = _FOLD[np.frombuffer(b" " + data[max(0, at - 2) : at + block] + b" ", np.uint8)].astype(np.uint32)
            pairs = one[:-1] * np.uint32(0x9E3779B1) + one[1:] * np.uint32(0x85EBCA77)
            triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + one[2:] * np.uint32(0x27D4EB2F)
            for hashed in (pairs, triples):
                out[i] += np.bincount((hashed ^ hashed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=SIZE)
        out[i, features.blank] = 0  # runs of what is no letter
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def _blank() -> list[int]:
    one = np.full(3, 32, np.uint32)
    pairs = one[:-1] * np.uint32(0x9E3779B1) + one[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + one[2:] * np.uint32(0x27D4EB2F)
    return [int(((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(20))[0]) for h in (pairs, triples)]


features.blank = _blank()


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """+1 and -1 by language and bit: all splits for up to five languages, else the widest apart of random codes."""
    if n <= 5:
        bits = [[1 if i == 0 or split >> (i - 1) & 1 else -1 for i in range(n)] for split in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.float32).reshape(-1, n).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, max(15, int(np.ceil(10 * np.log2(n))))))
        code = code[:, np.abs(code.sum(0)) < n]
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and ambiguity for texts that have letters."""
        value = features(texts) @ self.weights + self.bias
        loss = (np.logaddexp(0, -value[:, None, :] * self.code[None]) * self.trust).sum(2)
        order = np.argsort(loss, 1, kind="stable")
        share = np.exp(loss.min(1, keepdims=True) - loss)
        top = 1 / share.sum(1)
        second = np.take_along_axis(share, order[:, 1:2], 1)[:, 0] if len(self.languages) > 1 else np.zeros(len(texts))
        return [self.languages[k] for k in order[:, 0]], top, top * (1 - second) < self.margin


def fit(x: np.ndarray, langs: list[str], margin: float = 0.05, steps: int = 100, rate: float = 20.0) -> Model | None:
    """Logistic regressions of all bits at once, by accelerated gradient steps, from features and languages."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return None
    code = codewords(len(languages))
    target = code[[languages.index(a) for a in langs]]
    w, b = np.zeros((SIZE, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b = w, b
    for step in range(steps if code.shape[1] else 0):
        pull = -target / (1 + np.exp(np.clip(target * (x @ ahead_w + ahead_b), -30, 30))) / len(x)
        new_w, new_b = ahead_w - rate * (x.T @ pull + 1e-5 * ahead_w), ahead_b - rate * pull.sum(0)
        fast = step / (step + 3)
        ahead_w, ahead_b, w, b = new_w + fast * (new_w - w), new_b + fast * (new_b - b), new_w, new_b
    right = ((x @ w + b) * target > 0).mean(0) if code.shape[1] else np.ones(0)
    trust = np.maximum(2 * right - 1, 0.01)
    return Model(languages, code, w, b, trust, margin)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sampled(rows: DataFrame, group: str, quota: int, key: str = "doc_id") -> DataFrame:
    """About quota rows of each group at most, drawn by a hash of the key, so that any run draws the same ones."""
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, quota / n))])
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < share[F.col(group)] * (1 << 20))


def train(docs: DataFrame, per_language: int = 500, margin: float = 0.05) -> Model | None:
    """From docs(doc_id, text, lang): rows with a label and a letter. Tasks make their features; of these, whose number is
    bounded for each text, the sample's come to the driver."""
    rows = sampled(docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text"), "lang", per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = [(lang, text) for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True) if _LETTER.search(text)]
                made = features([text for _, text in some])
                places = [np.nonzero(x)[0].astype(np.int32) for x in made]
                yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in some], pa.string()), pa.array([i.tobytes() for i in places], pa.binary()), pa.array([x[i].tobytes() for x, i in zip(made, places, strict=True)], pa.binary())], ["lang", "places", "found"])

    got = rows.select("lang", "text").mapInArrow(run, "lang string, places binary, found binary").collect()
    x = np.zeros((len(got), SIZE), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["places"], np.int32)] = np.frombuffer(r["found"], np.float32)
    return fit(x, [r["lang"] for r in got], margin)


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def predict(docs: DataFrame, model: Model | None, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred, score and ambiguous, with that prefix; the text is the only input."""
    added = [T.StructField(prefix + f.name, f.dataType) for f in PREDICTED]
    if clash := {*docs.columns} & {f.name for f in added}:
        raise ValueError(f"docs has columns {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = [x or "" for x in some.column(some.schema.get_field_index(text)).to_pylist()]
                known = [i for i, x in enumerate(texts) if model and _LETTER.search(x)]
                lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if known:
                    said, top, near = model.decode([texts[i] for i in known])
                    for i, a in zip(known, said, strict=True):
                        lang[i] = a
                    score[known], unsure[known] = top, near
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lang), pa.array(score), pa.array(unsure)], [*some.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id"), 5) != 0))
    said = predict(docs.select("doc_id", "text"), model)
    return said.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
