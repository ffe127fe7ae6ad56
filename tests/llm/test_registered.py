"""The registered queries and the pipeline on a small table: columns, types and digests as the contract says, recomputed
here by plain Python, the libraries and DuckDB."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_pair_operators import found_words, shared_words, smallest, words
from test_text_operators import base
from tokenizers import Tokenizer

from tidewell.llm import bpe, packing, registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_substring_dedup": "doc_id bigint",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}
KINDS = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, query in registry.queries().items():
        frame = query(spark, SF)
        out[name] = dict(frame.dtypes), frame.collect()
    return out


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(results, name):
    types, rows = results[name]
    for column in COLUMNS[name].split(", "):
        column, kind = column.split()
        assert types[column] == kind, column
    assert rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(results, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    types, rows = results[name]
    assert sorted(types) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in rows))) == sorted(map(str, want.fetchall()))


def test_pii(results, documents):
    got = {r["doc_id"]: r for r in results["op1_pii"][1]}
    assert len(got) == len(documents)
    for doc, text, _ in documents:
        spans = base(text or "")
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = got[doc]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert {*filter(None, written.split(","))} <= {*r["spans"].split(",")}


def test_packing(results, documents):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    pieces, filled = {}, {}
    for r in results["op2_packing"][1]:
        pieces.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text, _ in documents:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_language(results, documents):
    got = {r["doc_id"]: r for r in results["op4_langid"][1]}
    right = []
    for doc, text, lang in documents:
        r = got[doc]
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and lang:
            right.append(r["lang_pred"] == lang)
    assert len(right) > 20 and np.mean(right) > 0.95


def test_media(results, documents):
    got = {r["doc_id"]: r for r in results["op5_media"][1]}
    same = {}
    for doc, text, _ in documents:
        data = (text or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > len(payload)
        assert same.setdefault(data, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_substring_dedup(results, documents):
    rows = [(doc, text or "") for doc, text, _ in documents]
    found = [{"doc_id": r["doc_id"], "start": int(a), "end": int(b)} for r in results["op6_substring_dedup"][1] for a, b in (s.split(":") for s in r["spans"].split(","))]
    got = found_words(rows, found)
    want = shared_words(rows, 50)
    assert want and all(w <= got.get(doc, set()) for doc, w in want.items())
    for r in results["op6_substring_dedup"][1]:
        assert all(s < r["doc_id"] for s in r["source_docs"]) and r["n_passages"] == len(r["spans"].split(","))


def test_bpe(results, documents):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in results["op7_bpe"][1]}
    for doc, text, _ in documents:
        ids = plain.encode_ordinary(text or "")
        r = got[doc]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_toxicity(results):
    marks = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    rows = results["op10_toxicity"][1]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    clean = [r["predicted"] for r in rows if marks.get(r["doc_id"]) == 0]
    assert np.mean(clean) < 0.1


def test_pipeline(spark, documents):
    """Every stage against brute force on what the stage before it kept, and run() against the stages."""
    import corpus_pipeline

    from tidewell.llm.common import Scratch, table

    scratch, docs, kept = Scratch(spark, "test"), table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
    names = [*dict(table(spark, SF, "documents").dtypes)]
    assert all([*kept[s][0].asDict()] == names for s, _ in corpus_pipeline.STAGES[:-1])
    text = lambda s: {r["doc_id"]: r["text"] for r in kept[s]}
    first = text("language")
    assert {*first} == {d for d, t, _ in documents if any(c.isalpha() for c in t or "")}

    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for d, w in ((d, words(t)) for d, t in first.items())}
    order = sorted(sets)
    links = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    second = text("near_copies")
    assert {*second} == {d for d, root in smallest(sets, links).items() if d == root}

    third = text("passages")
    assert {*third} == {*second}
    rows = sorted(second.items())
    assert not [d for d, w in shared_words([(d, third[d]) for d in third], 50).items() if d not in shared_words(rows, 50)]
    for doc, gone in shared_words(rows, 50).items():
        left = words(third[doc])
        assert len(left) <= len(words(second[doc])) - len(gone) + 2
    untouched = [d for d in second if second[d] == third[d]]
    assert len(untouched) > 0.7 * len(second)

    fourth = text("pii")
    assert {*fourth} == {*third} and not any(base(t) for t in fourth.values())
    assert all(fourth[d] == t for d, t in third.items() if not base(t) and not re.search("<TERM>", fourth[d]))

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    made = {}
    for r in sorted(kept["packing"], key=lambda r: (r["doc_id"], r["start"])):
        made[r["doc_id"]] = made.get(r["doc_id"], b"") + r["ids"]
    assert made == {d: np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in fourth.items()}
    assert packing.decompose(1025) == [1024, 1]

    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["start"], r["ids"]) for r in rows)
    assert key(whole) == key(kept["packing"])
