"""Jaccard join, substring dedup, embeddings, components, URLs, toxicity and the pipeline against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import embedding_dedup, jaccard_join, substring_dedup, toxicity, url_filter
from tidewell.llm.common import Scratch
from tidewell.llm.components import components, roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def smallest(ids, links):
    at = {x: i for i, x in enumerate(sorted(ids))}
    root = roots([(at[a], at[b]) for a, b in links], len(at))
    order = sorted(ids)
    return {x: order[root[at[x]]] for x in ids}


def near_docs(seed, groups=12, size=14, length=60):
    """Texts with random edits of common ones, copies, short ones and a line that most share."""
    rng, vocabulary, out = random.Random(seed), [f"w{i}" for i in range(3000)], []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(8, length))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text) + rng.choice(["", "", "\na line that many of them share word by word"]))
    out += ["", " ", "one", "One", "one two", "one  two", None, "same same same same same"]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("n", "percent", "tile", "few"), [(3, 90, 1 << 20, 32), (5, 80, 1 << 20, 3), (3, 80, 300, 2)])
def test_jaccard_classes(spark, n, percent, tile, few):
    rows = near_docs(n * percent)
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent, tile, few).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == smallest(sets, links)


def test_jaccard_odd_rows(docs, empty):
    got = jaccard_join.jaccard_classes(docs)
    assert got.count() == docs.count() and jaccard_join.jaccard_classes(empty).count() == 0
    by = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by[None] is None and by[48] == 48 and by[40] == 40


def test_first_shingles_are_shared():
    """Any two sets above the bound share as many first shingles as the bound says, whichever are common."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for size in (1, 4, 9, 20, 57, 200, 900):
            for _ in range(20):
                a = rng.integers(0, 1 << 62, size).astype(np.uint64)
                b = a.copy()
                gone = int(rng.integers(0, max(1, size * (100 - percent) // (100 + percent)) + 1))
                b[:gone] = rng.integers(0, 1 << 62, gone)
                b = np.unique(b[: size - int(rng.integers(0, 3))] if rng.random() < 0.3 else b)
                a = np.unique(a)
                overlap = len(np.intersect1d(a, b))
                if len(b) and 100 * overlap >= percent * (len(a) + len(b) - overlap):
                    common = np.sort(rng.permutation(a)[: int(rng.integers(0, size + 1))])
                    first, of, often = jaccard_join.first_shingles(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, percent, common, rng.integers(3, 9, len(common)))
                    bound = jaccard_join.shared(np.array([len(a), len(b)]), percent).min()
                    assert len({*first[of == 0].tolist()} & {*first[of == 1].tolist()}) >= bound
                    assert (often == np.isin(first, common)).all()


@pytest.mark.parametrize("few", [2, 4, 32])
def test_keys_that_meet(spark, few):
    """Pairs of keys of few sets and nodes of keys of more, whatever the batches."""
    rng = np.random.default_rng(few)
    rows = [(int(k), int(p), 100, None) for k in range(60) for p in rng.integers(0, 40, int(rng.integers(1, 9)))]
    rows += [(1000 + i, i, 100, 7) for i in range(5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = jaccard_join.met(spark.createDataFrame(rows, "key long, print long, n int, common long"), 80, few).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pairs, nodes, single = [], [(i, 7) for i in range(5)], []
    for k in range(60):
        marks = sorted({p for key, p, _, _ in rows if key == k})
        if len(marks) > few:
            nodes += [(p, k) for p in marks]
        elif len(marks) > 1:
            pairs += [(a, b) for i, a in enumerate(marks) for b in marks[i + 1 :]]
            single += marks
    assert sorted((r["a"], r["b"]) for r in got if r["b"] is not None) == sorted(pairs)
    assert sorted((r["a"], r["node"]) for r in got if r["node"] is not None) == sorted(nodes)
    assert sorted(r["a"] for r in got if r["b"] is None and r["node"] is None) == sorted(single)


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, least = int(rng.integers(1, 80)), int(rng.integers(1, 12))
        value = rng.permutation(n).astype(np.uint64)
        l, c, r = substring_dedup.compact_windows(value, np.array([0]), np.array([n]), least)
        for i in range(n):
            for j in range(i + least - 1, n):
                low = i + int(value[i : j + 1].argmin())
                assert sum(a <= i and j <= b and m == low for a, m, b in zip(l, c, r)) == 1
        assert all(b - a + 1 >= least for a, b in zip(l, r))


def test_substring_dedup(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage, short = fresh(60), fresh(20)
    near = passage.split()
    near[30] = "changed"
    rows = [(i, f"{fresh(40)}\n{passage} {fresh(30)}") for i in range(1, 6)] + [(10, f"{fresh(10)} {' '.join(near)}"), (11, passage)]
    rows += [(20 + i, f"{fresh(50)} {short} {fresh(50)}") for i in range(20)] + [(60, None), (61, ""), (62, fresh(49)), (63, fresh(200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated(frame)
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substring_dedup.merged(found).collect()}
    text = dict(rows)
    assert {*spans} == {2, 3, 4, 5, 10, 11}
    for i in (2, 3, 4, 5, 11):
        assert [text[i][a:b] for a, b in spans[i]] == [passage]
    assert len(spans[10]) == 1 and "changed" in text[10][slice(*spans[10][0])]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.removed(frame, found).collect()}
    assert left[1] == text[1] and left[11] == "" and passage not in left[3] and left[3].startswith(text[3].split("\n")[0]) and left[60] is None and left[63] == text[63]


def test_substring_wrong_pivot(spark):
    """Document 1 has every token of a passage that 2 and 3 share, in wide windows, but not the passage."""
    rng = random.Random(21)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    for length in (50, 75):
        passage = fresh(length)
        pivot = [w for k in range(length - 4) for w in [*fresh(60), *passage[k : k + 5], *fresh(60)]]
        texts = [" ".join(x) for x in (pivot, fresh(30) + passage + fresh(40), fresh(70) + passage + fresh(20))]
        found = substring_dedup.repeated(spark.createDataFrame([*enumerate(texts, 1)], "doc_id long, text string"))
        got = {r["doc_id"]: [texts[r["doc_id"] - 1][s["start"] : s["end"]] for s in r["spans"]] for r in substring_dedup.merged(found).collect()}
        assert got == {3: [" ".join(passage)]}


def decoy(rng, passage):
    """A document that has every token of a passage in wide windows, but not the passage."""
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    return [w for k in range(len(passage) - 4) for w in [*fresh(60), *passage[k : k + 5], *fresh(60)]]


def test_substring_near_beside_pivot(spark):
    """1 is the pivot of all keys and near to none. 2, 3 and 4 are near copies, none equal; 5 has the first part of the
    passage from 1, and all of it nearly from 4; 6 is near to 5 and to no other."""
    rng = random.Random(41)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    edited = lambda ws, *at: [fresh(1)[0] if k in at else w for k, w in enumerate(ws)]
    passage = fresh(150)
    two, three, four = edited(passage, 60), edited(passage, 85), edited(passage, 110)
    far = edited(four, 30, 52, 74, 97, 122)
    texts = [decoy(rng, passage) + passage[:55], *(fresh(20) + t + fresh(20) for t in (two, three, four)), fresh(9) + four[:55] + four[55:] + fresh(9), fresh(9) + far + fresh(30)]
    rows = [*enumerate((" ".join(t) for t in texts), 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (substring_dedup.repeated(frame.repartition(k)).collect() for k in (1, 5))
    assert sorted(one) == sorted(many)
    got = found_words(rows, one)
    assert {*got} >= {3, 4, 5, 6}
    for doc, text in ((3, three), (4, four), (5, four)):
        begin = texts[doc - 1].index(text[0])
        assert {*range(begin, begin + 150)} <= got[doc]
    assert len(got[6]) > 100


def test_passages_near_beside_pivot(spark):
    """The pipeline's stage cuts a near passage of 2 out of 3, though 1, which is near to neither, is the pivot."""
    import corpus_pipeline

    rng = random.Random(47)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(150)
    two, three = ([fresh(1)[0] if k == at else w for k, w in enumerate(passage)] for at in (60, 85))
    before, after = fresh(20), fresh(20)
    texts = [" ".join(t) for t in (decoy(rng, passage), two, before + three + after)]
    frame = spark.createDataFrame([*enumerate(texts, 1)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, frame, "").collect()}
    assert left[1] == texts[0] and left[2] == texts[1] and left[3].split() == before + after


@pytest.mark.parametrize("beside", [False, True])
def test_substring_every_near_passage(spark, beside):
    """Passages of 50 words and more with as many edits as the share allows are found, all of them; also where an earlier
    document has parts of each, so that no two of the others are its copies."""
    rng = random.Random(53)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts, pivots = {}, []
    for case in range(90):
        passage = fresh(rng.choice([50, 50, 50, 60, 70, 90, 110]))
        near = list(passage)
        for at in sorted(rng.sample(range(5, len(near) - 5), max(1, len(near) // 55)), reverse=True):
            near[at : at + rng.randrange(2)] = fresh(1)
        pivots += [w for k in range(0, len(passage) - 15, 10) for w in [*passage[k : k + 26], *fresh(60)]]
        texts[1000 + case], texts[2000 + case] = fresh(30) + passage + fresh(30), fresh(30) + near + fresh(30)
    if beside:
        texts |= {k: pivots[at : at + 2000] for k, at in enumerate(range(0, len(pivots), 1900), 1)}
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    got = found_words(rows, substring_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    met = 0
    for case in range(90):
        for a, b, *_ in substring_dedup.agreeing(five(texts[2000 + case]), five(texts[1000 + case]), 46, 0.8):
            met += 1
            assert {*range(a, b + 5)} <= got.get(2000 + case, set())
    assert met > 60


def test_substring_near_and_repeated(spark):
    """1 has a part of the passage before all of it; 2, which is near to that, has it at two places. 13 has one twice that
    is near to 12's and not to the pivot's, 11's."""
    rng = random.Random(59)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for base in range(0, 400, 20):
        passage, other = fresh(60), fresh(60)
        near, far = ([*p[:30], "edit", *p[31:]] for p in (passage, other))
        texts = {1: fresh(30) + passage[4:28] + fresh(60) + passage + fresh(9), 2: fresh(30) + near + fresh(50) + near + fresh(9)}
        texts |= {11: fresh(30) + other[4:28] + fresh(60), 12: fresh(40) + other + fresh(30), 13: fresh(30) + far + fresh(50) + far + fresh(9)}
        rows += [(base + k, " ".join(t)) for k, t in texts.items()]
        want |= {base + k: {*range(30, 90), *range(140, 200)} for k in (2, 13)}
    got = found_words(rows, substring_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {*got} == {*want} and all(w <= got[doc] for doc, w in want.items())


@pytest.mark.parametrize("most", [4096, 7])
def test_substring_runs_of_a_key(spark, most):
    """Each two runs of a key that agree in the least share: the later one is covered, by whichever earlier one."""
    rng, least, share = random.Random(43), 46, 0.8
    bases = [[rng.randrange(1 << 32) for _ in range(90)] for _ in range(4)]
    common = [rng.randrange(1 << 32) for _ in range(9)]
    rows = []
    for doc in range(60):
        base = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.randrange(1 << 32) for _ in range(90)]
        for _ in range(rng.randrange(1, 5)):
            at = rng.choice([*range(35), *range(49, 85)])
            base[at : at + 5] = [rng.randrange(1 << 32) for _ in range(5)]
        base[40:49] = common
        rows.append((1, doc, doc, 0, 0, 89, 44, bytearray(np.array(base, np.uint32).tobytes()), bytearray(12)))
    found = substring_dedup.linked(spark.createDataFrame(rows, substring_dedup._OPENED), least, share, most).collect()
    own = [np.frombuffer(r[7], np.uint32) for r in rows]
    covered = {}
    for r in found:
        a, b = own[r["doc"]][r["first"] : r["last"] + 1], own[r["pdoc"]][r["pfirst"] : r["plast"] + 1]
        assert r["pdoc"] < r["doc"] and len(a) >= least and len({*a} & {*b}) >= share * len({*a} | {*b})
        covered.setdefault(r["doc"], set()).update(range(r["first"], r["last"] + 1))
    want = [(i, p) for i in range(60) for j in range(i) for p in substring_dedup.agreeing(own[i], own[j], least, share)]
    assert len({i for i, _ in want}) > 25
    for i, (a, b, *_) in want:
        assert {*range(a, b + 1)} <= covered[i]


def five(text):
    return np.array([zlib.crc32(" ".join(text[k : k + 5]).encode()) for k in range(len(text) - 4)], np.uint64)


def _runs(rng, contents, covered=None):
    rows = []
    for doc, tokens in enumerate(contents):
        there = np.zeros(len(tokens), bool) if covered is None else rng.random(len(tokens)) < covered
        rows.append((1, doc, 0, 0, 0, len(tokens) - 1, 0, np.array(tokens, np.uint32), there, 0))
    return rows


def test_runs_that_share_too_little_are_not_compared(monkeypatch):
    rng, calls = np.random.default_rng(3), []
    plain = substring_dedup.agreeing
    monkeypatch.setattr(substring_dedup, "agreeing", lambda *a: calls.append(a) or plain(*a))
    head = list(range(43))  # would be enough for the share, and ends before the least length
    apart = [head + [1000 * (d + 1) + i for i in range(30)] for d in range(40)]
    assert not [*substring_dedup.Group(_runs(rng, apart), 46, 0.8).links(False)] and not calls
    # lines that repeat: one document has the key at 20 places, with equal contents
    lines = [[(100 * d if i >= 20 else 0) + i for i in range(31)] * 3 for d in (0, *[1] * 20)]
    rows = [(*r[:1], min(r[1], 1), *r[2:]) for r in _runs(rng, lines)]
    assert not [*substring_dedup.Group(rows, 46, 0.8).links(False)] and len(calls) <= 1


def test_bounds_lose_no_run():
    rng = np.random.default_rng(4)
    for n in range(150):
        words = int(rng.choice([3, 12, 60, 10000]))
        base = rng.integers(0, words, 60)
        contents = []
        for _ in range(int(rng.integers(2, 9))):
            own = base.copy()
            for _ in range(rng.integers(0, 4)):
                i = rng.integers(0, len(own))
                own = np.concatenate([own[:i], rng.integers(0, 20000, rng.integers(0, 6)), own[i + rng.integers(0, 6) :]])
            contents.append(own if len(own) >= 46 else base)
        rows = _runs(rng, contents, covered=n % 3 / 3)
        left = [r[8].copy() for r in rows]
        want = [u.copy() for u in left]
        for k in range(len(rows)):
            for j in range(k):
                for a, b, _, _ in substring_dedup.agreeing(rows[k][7], rows[j][7], 46, 0.8, 0):
                    want[k][a : b + 1] = True
        for doc, _, a, b, *_ in substring_dedup.Group(rows, 46, 0.8).links(False):
            left[doc][a : b + 1] = True
        assert all((x == y).all() for x, y in zip(left, want, strict=True)), n


@pytest.mark.parametrize("few", [True, False])
def test_runs_of_repeated_words_are_not_compared(monkeypatch, few):
    """Each word many times in a row: the runs of a key have that one word in common, and it is covered."""
    calls, plain = [], substring_dedup.agreeing
    monkeypatch.setattr(substring_dedup, "agreeing", lambda *a: calls.append(a) or plain(*a))
    if not few:
        monkeypatch.setattr(substring_dedup.Group, "shares", lambda self: None)
    rows = []
    for doc in range(60):
        own = [100 * (doc + 1) + i for i in range(10)]
        tokens = [own[0]] * 22 + own[1:5] + [7] * (51 + doc) + own[5:9] + [own[9]] * 22
        there = np.array([t in (own[0], 7) for t in tokens])
        rows.append((1, doc, 0, 0, 0, len(tokens) - 1, 0, np.array(tokens, np.uint32), there, 0))
    assert not [*substring_dedup.Group(rows, 46, 0.8).links(False)] and not calls


@pytest.mark.parametrize("repeats", [True, False])
def test_probes_lose_no_run(monkeypatch, repeats):
    """Groups whose tokens are too many for a product of matrices: the same passages; and few runs are given up only if they
    have none."""
    rng, found = np.random.default_rng(5), 0
    for n in range(120):
        base = rng.integers(0, 5 if n % 2 else 40, 70) if repeats else np.arange(70)
        contents = []
        for _ in range(int(rng.integers(2, 7))):
            own = base[rng.integers(0, 12) :].copy()
            for _ in range(rng.integers(0, 5)):
                i = rng.integers(0, len(own))
                own = np.concatenate([own[:i], rng.choice(10**6, rng.integers(0, 6), False) + 100, own[i + rng.integers(0, 6) :]])
            contents.append(own if len(own) >= 46 else base)
        rows = _runs(rng, contents, covered=n % 3 / 3)
        ways = []
        for probed in (False, True):
            with monkeypatch.context() as m:
                if probed:
                    m.setattr(substring_dedup.Group, "shares", lambda self: None)
                own = [(*r[:8], r[8].copy(), r[9]) for r in rows]
                ways.append([*substring_dedup.Group(own, 46, 0.8).links(False)])
        assert ways[0] == ways[1], n
        assert substring_dedup.hopeful(rows, 46, 0.8) or not ways[0], n
        found += len(ways[0])
    assert found > 50


@pytest.mark.parametrize("hot", [True, False])
def test_runs_by_bucket(hot):
    rng = np.random.default_rng(6)
    rows = np.zeros(500, substring_dedup.HOT if hot else substring_dedup.ROW)
    rows["deal"], rows["doc"] = rng.integers(0, 2**63, 500), rng.integers(-(2**63), 2**63 - 1, 500)
    rows["s1"], rows["whole"] = rng.integers(0, 9, 500), rng.integers(-9, 9, 500)
    batch = substring_dedup.dealt(rows, 300)
    got = []
    for bucket, often, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        part = np.frombuffer(data, rows.dtype)
        assert often == hot and len(part) and (hot or (part["deal"] % 300 == bucket).all())
        got += part.tolist()
    assert sorted(got) == sorted(rows.tolist()) and len({*batch.column(0).to_pylist()}) == batch.num_rows
    assert batch.num_rows == 1 or not hot


@pytest.mark.parametrize("buckets", [16, 64])
def test_rows_of_runs_grow_with_texts(spark, buckets):
    """Not with texts times buckets, however small the batches are."""
    rng = random.Random(8)
    frame = spark.createDataFrame([(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(300))) for i in range(2000)], "doc_id long, text string").repartition(1)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "10")
    try:
        found = substring_dedup.runs(frame, 5, 46, np.empty(0, np.uint64), buckets).select(F.length("runs").alias("n")).collect()
    finally:
        spark.conf.set(key, before)
    many = sum(r["n"] for r in found) / substring_dedup.ROW.itemsize
    assert len(found) <= many / 1024 + buckets


def test_agreeing_parts_of_a_run():
    """50 equal words before 100 of which every 7th is changed; four words put in by the other side."""
    own = [f"a{k}" for k in range(150)]
    other = [w if k < 50 or k % 7 else f"b{k}" for k, w in enumerate(own)]
    (first, last, x, _), *more = substring_dedup.agreeing(five(own), five(other), 46, 0.8)
    assert not more and first == x == 0 and 45 <= last < 70
    split = own[:70] + ["new"] * 4 + own[70:]
    assert substring_dedup.agreeing(five(own), five(split), 46, 0.8) == [(0, 145, 0, 149)]


def test_agreeing_equals_brute_force():
    """Passages of 50 to 200 words with blocks of words replaced, put in or left out."""
    rng, met, wide = random.Random(12), 0, 0
    for case in range(120):
        own = [f"a{k}" for k in range(rng.randrange(50, 201))]
        other = list(own)
        for e in range(rng.randrange(4)):
            at, n, new = rng.randrange(len(other)), rng.randrange(1, 13), rng.randrange(3)
            other[at : at + n * (new != 1)] = [f"b{case}.{e}.{k}" for k in range(n * (new > 0))]
        a, b = five([f"x{k}" for k in range(9)] + own), five([f"y{k}" for k in range(9)] + other)
        at = {t: k for k, t in enumerate(b)}
        same = [(i, at[t]) for i, t in enumerate(a) if t in at]
        spans = [(i, j) for p, (i, x) in enumerate(same) for q, (j, y) in enumerate(same[p:], 1) if j - i >= 45 and q >= 0.8 * (j - i + y - x + 2 - q) - 1e-9]
        want = [s for s in spans if not any(s != o and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
        assert [s[:2] for s in substring_dedup.agreeing(a, b, 46, 0.8)] == want
        met, wide = met + bool(want), wide + any(j - i > 60 and max(np.diff([p for p, _ in same if i <= p <= j])) > 8 for i, j in want)
    assert met > 40 and wide > 5
    own, block = [f"a{k}" for k in range(90)], [f"a{k}" if not 43 <= k < 47 else f"b{k}" for k in range(90)]
    assert substring_dedup.agreeing(five(own), five(block), 46, 0.8) == [(0, 85, 0, 85)]


def test_what_is_plain_is_what_agreeing_finds():
    rng, plain = random.Random(19), [0, 0]
    for case in range(300):
        own = [f"a{k}" for k in range(rng.randrange(40, 120))]
        other = [*(f"x{case}.{k}" for k in range(rng.randrange(9))), *own[rng.randrange(5) :][: rng.randrange(30, 120)], *(rng.choice(["q", f"y{k}", "a3"]) for k in range(rng.randrange(12)))]
        a, b = five(own), five([rng.choice(["p", w]) if rng.random() < 0.01 else w for w in other])
        at = {t: k for k, t in enumerate(b)}
        shift = next((k - at[t] for k, t in enumerate(a) if t in at), 0)
        found = substring_dedup.plainly(a, b, 46, 0.8, shift)
        if found is not None:
            plain[len(found)] += 1
            assert substring_dedup.agreeing(a, b, 46, 0.8, shift) == found
    assert min(plain) > 30


def test_distinct_shares():
    rng = np.random.default_rng(9)
    for _ in range(100):
        a, b = rng.integers(0, 12, 30).astype(np.uint64), rng.integers(0, 12, 34).astype(np.uint64)
        i, x = (int(v) for v in rng.integers(0, 8, 2))
        j, y = np.sort(rng.choice(np.arange(9, 31), 5, False)), np.sort(rng.choice(np.arange(9, 35), 5, False))
        sets = [({*a[i:p].tolist()}, {*b[x:q].tolist()}) for p, q in zip(j, y)]
        own, other, n, again = substring_dedup._repeats(a, b)
        assert again and substring_dedup._distinct(own, other, n, i, x, j, y, 0.6).tolist() == [len(u & v) >= 0.6 * len(u | v) for u, v in sets]


def test_nested_intervals(spark):
    """A = P, other words, Q and B = P, Q, each with edits: the interval of both fails, those of P and of Q pass."""
    rng = random.Random(31)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    edited = lambda ws, every: [f"e{rng.randrange(10**9)}" if k % every == every // 2 else w for k, w in enumerate(ws)]
    p, q = fresh(64), fresh(100)
    one, two = p + fresh(35) + q, edited(p, 64) + edited(q, 60)
    a, b = five(two), five(one)
    hits = [{"shift": h, "a": i, "b": j, "equal": False} for h, i, j in ((0, 0, 159), (0, 0, 59), (-35, 30, 159), (-35, 64, 159))]
    assert len(a) == 160 and len(b) == 195
    rows = [(None, 2, 1, 0, 0, 0, None, 7, " ".join(two), hits), (None, 2, 1, 1, 0, 0, None, 8, " ".join(one), None)]
    found = substring_dedup.verified(spark.createDataFrame(rows, substring_dedup._CUT), 5, 46, 0.8).collect()
    text = " ".join(two)
    got = {text[r["start"] : r["end"]] for r in found}
    assert any(two[0] in g.split() and two[63] in g.split() for g in got) and any(two[64] in g.split() and two[163] in g.split() for g in got)
    assert not any(two[0] in g.split() and two[163] in g.split() for g in got)


def shared_words(rows, passage):
    """Brute force: for each document the words of all exact passages that a document of a smaller id has."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        w = words(text)
        for k in range(len(w) - passage + 1):
            first.setdefault(tuple(w[k : k + passage]), doc)
    for doc, text in rows:
        w = words(text)
        covered = {i for k in range(len(w) - passage + 1) if first[tuple(w[k : k + passage])] < doc for i in range(k, k + passage)}
        if covered:
            out[doc] = covered
    return out


def found_words(rows, found):
    text, out = dict(rows), {}
    for r in found:
        begins = [m.span() for m in WORD.finditer(text[r["doc_id"]])]
        out.setdefault(r["doc_id"], set()).update(i for i, (a, b) in enumerate(begins) if r["start"] <= a and b <= r["end"])
    return out


@pytest.mark.parametrize("few_words", [False, True])
def test_substring_exact_passages(spark, few_words):
    """Every exact passage is found, however many documents have parts of it, and however rows are dealt."""
    rng = random.Random(77)
    vocabulary = [f"v{k}" for k in range(30)] if few_words else [f"v{k}" for k in range(100000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(rng.randrange(50, 90)) for _ in range(12)]
    parts = [w for p in passages for k in range(0, len(p) - 30, 3) for w in [*p[k : k + 30], *fresh(5)]]
    docs = [parts[k : k + 400] for k in range(0, len(parts), 350)]  # earlier ones, which have pieces only
    for _ in range(120):
        text = fresh(rng.randrange(0, 60))
        for p in rng.sample(passages, rng.randrange(1, 4)):
            cut = rng.randrange(0, 12)
            text += [*p[cut:], *fresh(rng.randrange(0, 40))] if rng.random() < 0.7 else [*p[: len(p) - cut], *fresh(3)]
        docs.append(text)
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (substring_dedup.repeated(frame.repartition(k)).collect() for k in (1, 16))
    assert sorted(one) == sorted(many)
    want, got = shared_words(rows, 50), found_words(rows, one)
    assert len(want) > 80
    assert all(w <= got.get(doc, set()) for doc, w in want.items())


def test_substring_hot_passage(spark):
    """A passage that all documents have, with other words around it, and one that two have inside of it."""
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(70)
    rows = [(i, " ".join([*fresh(20), *passage, *fresh(20)])) for i in range(600)]
    rows += [(700 + i, " ".join([*passage[:40], *passage[20:]])) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hot = substring_dedup.hot_keys(frame, 5, 46)
    assert len(hot)
    one, many = (substring_dedup.repeated(frame.repartition(k)).collect() for k in (1, 7))
    assert sorted(one) == sorted(many)
    got = found_words(rows, one)
    assert {*got} == {*range(1, 600), 700, 701, 702}
    assert all(w <= got[doc] for doc, w in shared_words(rows, 50).items())


def test_substring_same_id(spark):
    """What is found in one text of an id isn't cut out of another one."""
    rng = random.Random(15)
    passage, other = (" ".join(f"u{rng.randrange(10**9)}" for _ in range(n)) for n in (60, 80))
    rows = [(1, passage, 5, "x"), (2, passage, 6, "y"), (2, other, 7, "z"), (2, passage, 8, "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark int, `Spans` string")
    left = sorted((r["mark"], r["text"], r["Spans"]) for r in substring_dedup.removed(frame, substring_dedup.repeated(frame)).collect())
    assert left == [(5, passage, "x"), (6, "", "y"), (7, other, "z"), (8, "", "w")]


def test_substring_odd_rows(docs, empty):
    found = substring_dedup.repeated(docs)
    assert substring_dedup.removed(docs, found).count() == docs.count()
    assert substring_dedup.removed(docs, found).columns == docs.columns
    assert substring_dedup.repeated(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centers[i % 12] + rng.normal(size=16) * rng.choice([0, 0.02, 0.1])], int(i % 12 % 3)) for i in range(300)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 1), (None, rows[1][1], 1)]
    good = [(i, np.array(v), c) for i, v, c in rows if i is not None and v and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, c in good for b, y, d in good if a < b and c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    want = smallest([r[0] for r in rows if r[0] is not None], links)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (7, 1024):
        got = embedding_dedup.linked(frame, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is not None:
                assert (r["component_id"], r["n_links"]) == (want[r["vec_id"]], sum(r["vec_id"] in p for p in links)), r
                assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert embedding_dedup.linked(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 701 + i) for i in range(50)]
    want = smallest({x for p in links for x in p}, links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(v == k for k, v in want.items() if k not in got)


def test_url_filter(spark):
    urls = ["http://a.org/x", "HTTP://A.Example.ORG/es/1", "http://example.org/en/17", "http://notexample.org/es/1", "http://b.com/fr/", "http://b.com/de", "http://b.com/de/x?y#z", "http://c.net", None, "nothing", "http://www.big-casino.net/x", "http://casino.big.net?q", "x://y.org?/es/", "http://org/", "://", "http://"]
    frame = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(frame, url_filter.hosts_with_parts(frame)).collect()}
    want = [("a.org", "/x", "org/", "allow"), ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"), ("notexample.org", "/es/1", "org/", "allow"), ("b.com", "/fr/", "com/fr/", "allow"), ("b.com", "/de", None, "allow"), ("b.com", "/de/x", "com/de/", "block"), ("c.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.big-casino.net", "/x", None, "block"), ("casino.big.net", "", None, "block"), ("y.org", "", None, "allow"), ("org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
    assert [got[i] for i in range(len(urls))] == want
    assert url_filter.judge_urls(frame.limit(0), url_filter.hosts_with_parts(frame.limit(0))).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("id % 11 = 0")
    cascade = url_filter.build_cascade(listed, keys, error=0.2)
    assert len(cascade.levels) > 2
    got = keys.select("key", url_filter.flag(cascade, F.array("key"))[0].alias("f"))
    assert {r["key"] for r in got.where("f").collect()} == {r["key"] for r in listed.collect()}
    several = keys.groupBy(F.pmod(F.hash("key"), F.lit(50))).agg(F.collect_list("key").alias("keys"))
    for most in (1 << 28, 64):  # beyond 64 bits the list is asked by joins
        said = url_filter.flagged(several, "keys", listed, "f", 0.2, most).select(F.explode(F.arrays_zip("keys", "f")).alias("x"))
        assert {r["x"]["keys"] for r in said.where("x.f").collect()} == {r["key"] for r in listed.collect()} and said.count() == 3000
    with pytest.raises(url_filter.TooManyKeys):
        url_filter.build_cascade(listed, keys, max_bits=64)


def test_toxicity(spark, docs, empty):
    rng = random.Random(5)
    clean = lambda: " ".join(f"c{rng.choice('abcdefgh')}{rng.choice('aeiou')}r{rng.choice('xyz')}" for _ in range(40))
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        rows.append((i, clean() + (" " + " ".join(rng.sample(["idiot", "moron", "blarghen", "blargsam", "blargot", "scum"], 3)) if bad else "")))
        labels.append((i, int(bad)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    scorer = toxicity.train(frame, marks.where(~F.col("doc_id").isin(*held)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, scorer).collect()}
    right = [(got[i] >= 0.7) == bool(t) for i, t in labels if i in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, scorer).collect()) and toxicity.score(empty, scorer).count() == 0
    assert toxicity.score(docs, toxicity.train(empty, marks.limit(0))).count() == docs.count()


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline

    for name, frame in (("docs", docs), ("empty", empty)):
        kept = frame
        for stage, f in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{stage}"
            f(spark, kept, "").write.parquet(path)
            kept = spark.read.parquet(path)
            if stage != "packing":
                assert kept.columns == frame.columns
            if name == "docs" and stage == "language":
                assert {r["doc_id"] for r in frame.select("doc_id").collect()} - {r["doc_id"] for r in kept.select("doc_id").collect()} == {40, 41, 42, 43}
            if name == "docs" and stage == "near_copies":
                assert kept.where("doc_id = 48").count() == 1 and kept.where("doc_id is null").count() == 1
        assert (kept.count() > 0) == (name == "docs")


def test_embeddings_of_any_size(spark):
    """Finite vectors whose squares leave the range of doubles link as others do."""
    rows = [(1, [1e-200, 0.0], 1), (2, [2e-200, 0.0], 1), (3, [1e200, 0.0], 1), (4, [2e200, 1e190], 1), (5, [0.0, 3.0], 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, None, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8)}
