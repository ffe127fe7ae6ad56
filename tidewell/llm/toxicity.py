"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. A fixed lexicon, writing patterns, and words or word beginnings (4 to 7 letters, once or in several words) that stand out in toxic
   labelled rows of the learning folds. A voter votes "toxic" or abstains.
2. Label model. Spark sums each voter's votes and each pair's common votes over all documents. Given the class, most
   voters are independent, so off-diagonal covariances factor as d_i * d_j; each d_i is fitted to its positively
   covarying voters (voters of other languages never meet), and to one more voter of known rates, the labels, which
   votes on the labelled sample alone. That gives a voter's rates in either class. What remains of a covariance beyond
   d_i * d_j is correlation, and correlated voters share their weight.
3. The posterior of a document is the prior's log odds and the summed weights of its votes. A logistic regression over
   the voters and a bias is fitted to the posteriors of a bounded sample of labelled rows of the learning folds; its
   value is the score. Labels choose voters, give the prior and steady the rates; they are no target.

Bounds: at most ``quota`` labelled rows of each class are learned from. All markers of theirs that stand out vote; how
many can is bounded by the sample.
Cases: a null or empty text scores like one without votes; a null doc_id is in no fold; without any toxic label there
are only the fixed voters; repeated rows repeat their result, repeated labels of one id count once (toxic wins);
very long texts are read whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table
from tidewell.llm.langid import fold, sampled

# Insults and writing patterns that vote whatever the labels say.
LEXICON = ("idiot", "moron", "scum", "trash", "stupid", "worthless", "pathetic", "loser", "clown", "disgusting", "imbecile", "filth", "vermin", "dumb", "ugly", "hate")
PATTERNS = {"~shout": r"\b[A-Z]{4,}[!]", "~bangs": r"!!!+", "~you_are": r"(?i)\byou(?:'re| are) (?:a |an |such )", "~censored": r"\b\w\*{2,}\w*", "~wish": r"(?i)\b(?:shut up|go away|get lost)\b"}
_WORD, _PATTERNS = re.compile(r"[^\W\d_]+"), {k: re.compile(p) for k, p in PATTERNS.items()}


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def markers(text: str) -> set[str]:
    """Whole words as =word, word beginnings as word-, beginnings of two words and more as word+."""
    found = words(text)
    starts = Counter(w[:n] for n in (4, 5, 6, 7) for w in found if len(w) > n)
    return {"=" + w for w in found} | {s + "-" for s in starts} | {s + "+" for s, n in starts.items() if n > 1}


class Voters(dict):
    """Voters and their numbers, and what their beginnings are, by length."""

    def __init__(self, names: list[str]):
        super().__init__((k, i) for i, k in enumerate(names))
        starts = {k[:-1] for k in names if k[-1] in "-+"}
        self.starts = [(n, frozenset(s for s in starts if len(s) == n)) for n in sorted({len(s) for s in starts})]

    def __reduce__(self):
        return Voters, ([*self],)


def votes(text: str, voters: Voters) -> list[int]:
    """The numbers of the voters that say toxic."""
    seen = words(text)
    found = {voters[k] for w in seen if (k := "=" + w) in voters}
    starts = Counter(w[:n] for n, known in voters.starts for w in seen if len(w) > n and w[:n] in known)
    found |= {voters[k] for s, n in starts.items() for k in (s + "-", s + "+") if k in voters and (n > 1 or k[-1] == "-")}
    return sorted(found | {voters[k] for k, p in _PATTERNS.items() if k in voters and p.search(text)})


def mine(rows: DataFrame, least_lift: float = 10, least_llr: float = 20) -> list[str]:
    """rows(text, toxic), bounded: markers ten times as common in toxic rows as in others, by a log-likelihood ratio
    that chance doesn't reach. A marker that begins with one already kept is left out, as its rows are the other's."""
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(1):
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (bad if toxic else good).update(markers(text or ""))
        keys = [*bad.keys() | good.keys()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([good[k] for k in keys], pa.int64())], ["marker", "bad", "good"])

    sums = rows.select("text", "toxic").mapInArrow(count, "marker string, bad long, good long").groupBy("marker").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n_bad, n_good = totals[1], totals.get(0, 0)
    lift = (F.col("bad") / n_bad) / ((F.col("good") + 0.5) / (n_good + 1))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    llr = 2 * (F.col("bad") * F.log(share * (n_bad + n_good) / n_bad) + F.col("good") * F.log(F.greatest(1 - share, F.lit(1e-12)) * (n_bad + n_good) / max(1, n_good)))
    best = sums.where((F.col("bad") >= 3) & (lift >= least_lift) & (llr >= least_llr)).orderBy(F.desc("bad"), F.length("marker"), "marker").collect()
    kept: dict[str, None] = {}
    for (m,) in ((r["marker"],) for r in best):
        stem = m.strip("=-+")
        starts = [stem[:n] for n in range(4, min(7, len(stem)) + 1)]
        if not any(s + "-" in kept or m[-1] == "+" and s + "+" in kept for s in starts):
            kept[m] = None
    return [*kept]


@dataclass(frozen=True)
class LabelModel:
    prior: float
    hit: np.ndarray  # P(vote | toxic)
    noise: np.ndarray  # P(vote | not toxic)
    correlation: np.ndarray
    weights: np.ndarray  # log odds of a vote, shared among correlated voters
    silent: float = 0.1  # the share of toxic documents that no voter is taken to know

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Of rows of votes. A row without any is toxic by the prior times ``silent``; others start from the prior."""
        rest, own = (np.log(p / (1 - p)) for p in (self.prior * self.silent, self.prior))
        return 1 / (1 + np.exp(-np.clip(np.where(x.any(1), own, rest) + x @ self.weights, -30, 30)))


def label_model(n: int, ones: np.ndarray, both: np.ndarray, prior: float, labelled: tuple[np.ndarray, np.ndarray] | None = None) -> LabelModel:
    """From sums over all documents: n of them, votes by voter, common votes by pair. labelled: the share of toxic and of
    other labelled rows that each voter votes on."""
    mean = ones / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    size = len(mean)
    friends = (cov > 1e-9) & ~np.eye(size, dtype=bool)
    d = np.sqrt(np.clip(np.diag(cov), 0, None)) * 0.7
    for _ in range(50):  # least squares over the friends, one factor
        top, low = (cov * friends) @ d, friends @ d**2
        if labelled:
            top, low = top + (labelled[0] - labelled[1]) * (prior * (1 - prior)) ** 1.5, low + prior * (1 - prior)
        d = np.clip(0.5 * d + 0.5 * np.where(low > 1e-12, top / np.maximum(low, 1e-12), 0), 0, None)
    odds = np.sqrt((1 - prior) / prior)
    hit, noise = np.clip(mean + d * odds, 1e-4, 0.999), np.clip(mean - d / odds, 1e-5, 0.999)
    if labelled:  # a small difference of sums says less about rare noise than labelled rows do
        noise = np.maximum(noise, labelled[1])
    noise = np.minimum(noise, hit)
    spread = np.sqrt(np.maximum(np.outer(np.diag(cov), np.diag(cov)), 1e-18))
    correlation = np.where(friends, np.clip((cov - np.outer(d, d)) / spread, 0, 1), 0)
    weights = np.log(hit / noise) / (1 + np.where(correlation > 0.3, correlation, 0).sum(1))
    return LabelModel(prior, hit, noise, correlation, np.clip(weights, 0, 8))


def count_votes(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray, np.ndarray]:
    """One pass over all documents: how many, votes by voter, common votes by pair of voters that meet."""
    size = len(voters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [np.empty(0, np.int64)]
            for text in batch.column(0).to_pylist():
                at = np.array(votes(text or "", voters), np.int64)
                met.append((at[:, None] * size + at).ravel())
            pair, n = np.unique(np.concatenate(met), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(pair, -1)), pa.array(np.append(n, batch.num_rows))], ["pair", "n"])

    sums = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    inside = sums[sums["pair"] >= 0]
    both = np.zeros(size * size)
    both[inside["pair"].to_numpy(np.int64)] = inside["n"]
    both = both.reshape(size, size)
    return int(sums[sums["pair"] < 0]["n"].sum()), np.diag(both).copy(), both


@dataclass(frozen=True)
class Scorer:
    voters: Voters
    weights: np.ndarray
    any: float  # for rows with a vote
    bias: float

    def score(self, text: str) -> float:
        at = votes(text, self.voters)
        return float(1 / (1 + np.exp(-np.clip(self.bias + (self.any + self.weights[at].sum() if at else 0), -30, 30))))


def fit(rows: list[list[int]], voters: Voters, model: LabelModel, steps: int = 25) -> Scorer:
    """A ridge logistic regression on the posteriors of rows of votes, by Newton's steps."""
    x = np.zeros((len(rows), len(voters)), np.float64)
    for i, at in enumerate(rows):
        x[i, at] = 1
    y = model.posterior(x)
    x = np.column_stack([x, x.any(1), np.ones(len(rows))])
    w, ridge = np.zeros(len(voters) + 2), np.diag([0.2] * len(voters) + [1e-3] * 2)
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(slope, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    if not len(rows):
        w[-1] = -4.0
    return Scorer(voters, w[:-2], float(w[-2]), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, quota: int = 3000) -> Scorer:
    """docs(doc_id, text): all; labels(doc_id, toxic): those of the learning folds. Of the sample's texts only votes
    come to the driver."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    totals = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    prior = min(0.5, max(0.001, totals.get(1, 0) / max(1, sum(totals.values()))))
    chosen = sampled(marks, "toxic", quota)  # two classes, so about 2 * quota rows at most: small enough to broadcast
    sample = scratch.write(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "sample")
    voters = Voters([*dict.fromkeys([*("=" + w for w in LEXICON), *PATTERNS, *mine(sample)])])

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t or "", voters) for t in batch.column(0).to_pylist()], pa.list_(pa.int64())), batch.column(1)], ["votes", "toxic"])

    learned = sample.select("text", "toxic").mapInArrow(cast, "votes array<long>, toxic int").collect()
    scratch.drop("sample")
    shares = []
    for kind in (1, 0):
        rows = [r["votes"] for r in learned if r["toxic"] == kind]
        shares.append((np.bincount([i for at in rows for i in at], minlength=len(voters)) + 0.05) / (len(rows) + 1))
    model = label_model(*count_votes(docs, voters), prior, tuple(shares) if len({r["toxic"] for r in learned}) == 2 else None)
    return fit([r["votes"] for r in learned], voters, model)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of every row; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scorer = train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return score(docs, scorer).select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
