"""Quality by weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation on the counts of
their joint votes, over all documents, estimates how accurate each labeller is and what share is good, and so
the posterior of every combination of votes. The posteriors label a bounded sample of documents, on which a
linear scorer over hashed shape features is trained. The scorer then judges all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many documents are what the scorer is trained on at most; rows are chosen one by one at random.
TRAIN_DOCS = 20_000
#: Hashed features, steps and weight decay of the scorer.
DIMS, STEPS, DECAY = 1 << 12, 300, 1e-3
#: Documents that score less are low quality.
THRESHOLD = 0.5
#: Shares among fewer words than this say little: labellers abstain, and the scorer's features are damped.
FEW = 5

ABSTAIN, BAD, GOOD = 0, 1, 2

SEED = 42

_SHAPES = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def _vote(value: float, bad_above: float, good_below: float) -> int:
    return BAD if value > bad_above else GOOD if value < good_below else ABSTAIN


def votes(text: str | None) -> tuple[int, ...]:
    """What each labeller says of a text; all abstain on a text of fewer than FEW words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if n < FEW:
        return (ABSTAIN,) * len(LABELLERS)
    shape = data.translate(_SHAPES)
    letters, capitals = shape.count(b"a") + shape.count(b"A"), shape.count(b"A")
    marks = sum(data.count(bytes([c])) for c in b"#$%&*<>{}|~^")
    stops = sum(data.count(bytes([c])) for c in b".!?")
    same = sum(a == b for a, b in zip(words, words[1:]))
    ends = sum(w.endswith(b"!!") for w in words)
    return (
        _vote(marks / n, 0.3, 0.02),
        _vote(same / n, 0.2, 0.05),
        _vote(capitals / max(1, letters), 0.5, 0.2),
        _vote(words.count(b"|") / n, 0.2, 0.01),
        _vote(len(set(words)) / n * -1 if n >= 20 else -1, -0.3, -0.5),
        _vote(ends / n, 0.2, 0.01),
        _vote(n / (stops + 1), 120, 40),
        _vote(1 - letters / max(1, len(shape) - shape.count(b" ")), 0.25, 0.12),
    )


#: What the labellers look at, in the order of their votes.
LABELLERS = ("marks", "repeated words", "capitals", "bars", "few words", "shouting", "no sentences", "few letters")


def _pattern(text: str | None) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(text)))


def _unpack(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 for i in range(len(LABELLERS))]


def _patterns(texts: pd.Series) -> pd.Series:
    return pd.Series([_pattern(t) for t in texts], dtype="int32")


def estimate(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """The posterior of being good for each pattern of votes, by EM on the patterns' counts.

    Labellers are taken as independent given the truth; each has a chance of every vote on good and on bad
    documents. At the start a bad vote is rare on good documents, which tells good from bad. A pattern is at
    most 3 ** labellers rows, whatever the number of documents.
    """
    pats = sorted(counts)
    seen = np.array([_unpack(p) for p in pats], np.int64).reshape(len(pats), len(LABELLERS))
    times = np.array([counts[p] for p in pats], float)
    prior = np.array([[0.10, 0.02, 0.88], [0.20, 0.40, 0.40]])  # of abstaining, bad, good; on good, on bad documents
    chance = np.repeat(prior[:, None, :], len(LABELLERS), axis=1)
    share = 0.8
    post = np.full(len(pats), share)
    each = np.arange(len(LABELLERS))
    for _ in range(rounds):
        logs = np.log(chance)
        a = np.log(share) + logs[0, each, seen].sum(axis=1)
        b = np.log(1 - share) + logs[1, each, seen].sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        share = float(np.clip((times * post).sum() / max(1.0, times.sum()), 0.5, 0.99))
        for c, w in enumerate((times * post, times * (1 - post))):
            for v in (ABSTAIN, BAD, GOOD):
                chance[c, :, v] = (w[:, None] * (seen == v)).sum(axis=0) + 5 * prior[c, v]
        chance /= chance.sum(axis=2, keepdims=True)
    return dict(zip(pats, post.tolist()))


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Hashed features of a whole text: the shares of its words' shapes, and of words that repeat the one before."""
    data = (text or "").encode()
    shapes = _RUN.sub(rb"\1", data.translate(_SHAPES)).split()
    n = len(shapes)
    if not n:
        return [], []
    words = data.split()
    counts = Counter(shapes)
    counts[b"\x00same"] = sum(a == b for a, b in zip(words, words[1:]))
    counts[b"\x00old"] = n - len(set(words)) if n >= 20 else 0
    slots: dict[int, float] = {}
    for s, c in counts.items():
        if c:
            at = zlib.crc32(s) % DIMS
            slots[at] = slots.get(at, 0.0) + (c / n) ** 0.5 * n / (n + FEW)
    return list(slots), list(slots.values())


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, x = features(text)
        return 1 / (1 + float(np.exp(-self.bias - float(np.dot(self.weights[at], x) if at else 0.0))))


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [features(t) for t in batch["text"]]
        yield pd.DataFrame({"pattern": batch["pattern"], "slots": [a for a, _ in got], "values": [x for _, x in got]})


def sample(docs: DataFrame, n: int) -> DataFrame:
    """(pattern, slots, values) of about TRAIN_DOCS of the ``n`` rows, repeated rows one by one as well."""
    part = min(1.0, TRAIN_DOCS / max(1, n))
    some = docs.select("text").where(F.rand(SEED) < part).withColumn("pattern", F.pandas_udf(_patterns, "int")("text"))
    return some.select("pattern", "text").mapInPandas(_sample, "pattern int, slots array<int>, values array<double>")


def _descend(rows: pa.Table, posterior: dict[int, float]) -> Scorer:
    """Logistic regression on soft labels by Adam."""
    slots, values = rows["slots"].combine_chunks(), rows["values"].combine_chunks()
    doc = np.repeat(np.arange(len(rows)), slots.value_lengths().to_numpy(zero_copy_only=False))
    at = slots.flatten().to_numpy()
    x = values.flatten().to_numpy()
    y = np.array([posterior[p] for p in rows["pattern"].to_pylist()])
    weight = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).sum()), 0.5 / max(1e-9, (y < 0.5).sum()))
    theta = np.zeros(DIMS + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(doc, theta[at] * x, len(rows))
        e = weight * (y - 1 / (1 + np.exp(-z)))
        g = np.append(np.bincount(at, e[doc] * x, DIMS), e.sum())
        g[:-1] -= DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Scorer(theta[:-1], float(theta[-1]))


def fit(docs: DataFrame) -> tuple[Scorer, dict[int, float]]:
    """(the scorer, the posterior by pattern of votes); the votes of all documents are counted."""
    pattern = F.pandas_udf(_patterns, "int")
    voted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("pattern", pattern("text"))
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = estimate(counts)
    return _descend(sample(docs, sum(counts.values())).toArrow(), posterior), posterior


def assess(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, pattern (votes, base 3), posterior, score (0 to 1, higher: better), keep.

    Null and wordless texts get all abstentions and the scorer's bias; texts of any length are read whole;
    ties and repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scorer, posterior = fit(docs)
    shared = spark.sparkContext.broadcast((scorer, posterior))  # DIMS weights, 3 ** labellers posteriors

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, post = shared.value
        for batch in batches:
            patterns = [_pattern(t) for t in batch["text"]]
            scores = [of.score(t) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "pattern": patterns, "posterior": [post.get(p, 0.5) for p in patterns], "score": scores, "keep": [s >= THRESHOLD for s in scores]}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(judge, "doc_id long, pattern int, posterior double, score double, keep boolean")
