"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is a bag of sentences; a sentence that holds one of the model's words
is toxic with a logistic probability, and the document is toxic if any sentence is, or by a small leak
(noisy-or). Gradient ascent on the documents' labels finds the words' weights, and so which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import cut

#: About so many labelled documents are trained on at most, chosen by the hash of their ids.
TRAIN_DOCS = 20_000
#: The most words that a model has, the distinct toxic sentences that each needs, and its least z score.
MAX_WORDS, MIN_SENTENCES, MIN_Z = 4_096, 5, 4.0
STEPS, RATE, DECAY = 400, 0.1, 0.1
THRESHOLD = 0.7

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def _lower(text: str | None) -> str:
    """A-Z lower-cased, nothing else."""
    return (text or "").encode().lower().decode()


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float

    def sentence(self, words: set[str]) -> float:
        """The probability that a sentence is toxic; 0 without any of the model's words."""
        known = words & self.weights.keys()
        return 1 / (1 + float(np.exp(-self.bias - sum(self.weights[w] for w in sorted(known))))) if known else 0.0

    def document(self, text: str | None) -> tuple[float, list[tuple[int, float, str]]]:
        """(score, [(sentence from 0, its score, its text)] of those with any of the model's words)."""
        none, found = 1 - self.leak, []
        low = _lower(text)
        if not self.weights.keys().isdisjoint(WORD.findall(low)):
            for i, m in enumerate(SENTENCE.finditer(low)):
                p = self.sentence(set(WORD.findall(m[0])))
                if p:
                    none *= 1 - p
                    found.append((i, p, text[m.start() : m.end()].strip()))
        return 1 - none, found


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (sentence's hash, its words)."""
    for batch in batches:
        ids, words = [], []
        for text in batch["text"]:
            for m in SENTENCE.finditer(_lower(text)):
                ids.append(xxhash.xxh64_intdigest(m[0].strip().encode()) >> 1)
                words.append(sorted(set(WORD.findall(m[0]))))
        yield pd.DataFrame({"id": ids, "words": words})


def _counted(rows: DataFrame, name: str, only: DataFrame | None = None) -> DataFrame:
    """(word, ``name``): in how many distinct sentences of ``rows`` each word is; copies count once.

    ``only``: the words to count, fewer than TRAIN_DOCS documents hold.
    """
    each = rows.select("text").mapInPandas(_sentences, "id long, words array<string>").select("id", F.explode("words").alias("word"))
    if only is not None:
        each = each.join(F.broadcast(only), "word", "left_semi")
    return each.distinct().groupBy("word").agg(F.count(F.lit(1)).alias(name))


def _bags(chosen: dict[str, int]):
    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                each = (set(WORD.findall(m[0])) & chosen.keys() for m in SENTENCE.finditer(_lower(text)))
                rows.append([sorted(chosen[w] for w in s) for s in each if s])
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "bags": rows})

    return bags


def training_rows(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """(id, text, toxic) of about TRAIN_DOCS labelled documents, those that ``held_out`` names left out.

    A document with contradictory labels counts as toxic; rows without a doc_id or a label don't count. Of
    rows that repeat a doc_id the least text is read, so there is a row for each id at most.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.dropna().groupBy("_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        known = known.where(~held_out(F.col("_id")))
    known = cut(known, "tox-labels")
    part = int((1 << 30) * min(1.0, TRAIN_DOCS / max(1, known.count())))
    some = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < part)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(some), "_id")
    return texts.groupBy(F.col("_id").alias("id")).agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def fit(rows: DataFrame) -> Model:
    """A model of (id, text, toxic). Without rows of both labels it scores every text alike."""
    rows = cut(rows, "tox-rows")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    leak = min(0.3, (n1 + 0.5) / (n1 + n0 + 1))
    if not n1 or not n0:
        return Model({}, 0.0, leak)
    words = _counted(rows.where("toxic = 1"), "a").where(F.col("a") >= MIN_SENTENCES)
    clean = _counted(rows.where("toxic = 0"), "b", words.select("word"))
    b = F.coalesce("b", F.lit(0)) + 1  # so that a word in no clean sentence isn't certain
    pooled = F.least((F.col("a") + b) / (n1 + n0), F.lit(0.5))
    z = (F.col("a") / n1 - b / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    ranked = words.join(clean, "word", "left").select("word", z.alias("z")).where(F.col("z") >= MIN_Z)
    chosen = [r["word"] for r in ranked.orderBy(F.desc("z"), "word").limit(MAX_WORDS).collect()]
    index = {w: i for i, w in enumerate(chosen)}
    bags = rows.mapInPandas(_bags(index), "id long, toxic int, bags array<array<int>>")
    data = bags.toArrow().sort_by("id")  # TRAIN_DOCS rows at most, of a few words each
    return _ascend(chosen, data, leak)


@dataclass(frozen=True)
class Bags:
    """Documents' labels and, word by word, which document's sentence holds which word."""

    label: np.ndarray  # of each document
    doc: np.ndarray  # of each bag, that is, sentence
    bag_of: np.ndarray  # of each word in a bag
    word_of: np.ndarray
    words: int

    def likelihood(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean log-likelihood of the labels, its gradient); theta: words' weights, bias, logit of the leak."""
        n, m = len(self.label), len(self.doc)
        x = theta[-2] + np.bincount(self.bag_of, theta[self.word_of], m)
        p, q = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(-theta[-1]))
        none = np.log1p(-q) + np.bincount(self.doc, -np.logaddexp(0, x), n)  # log of no toxic sentence
        some = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(self.label == 1, np.exp(none) / some, -1.0)  # d likelihood / d(-none)
        gb = pull[self.doc] * p
        gradient = np.concatenate([np.bincount(self.word_of, gb[self.bag_of], self.words), [gb.sum(), (pull * q).sum()]]) / n
        return float(np.where(self.label == 1, np.log(some), none).sum() / n), gradient


def _ascend(chosen: list[str], data: pa.Table, leak: float) -> Model:
    """Gradient ascent (Adam) on the noisy-or likelihood of the documents' labels."""
    per_doc = data["bags"].combine_chunks()
    per_bag = per_doc.flatten()
    label = data["toxic"].combine_chunks().to_numpy()
    doc = np.repeat(np.arange(len(label)), per_doc.value_lengths().to_numpy(zero_copy_only=False))
    bag_of = np.repeat(np.arange(len(per_bag)), per_bag.value_lengths().to_numpy(zero_copy_only=False))
    bags = Bags(label, doc, bag_of, per_bag.flatten().to_numpy(), len(chosen))
    theta = np.zeros(len(chosen) + 2)
    theta[-2], theta[-1] = -1.0, np.log(leak / (1 - leak))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        g = bags.likelihood(theta)[1]
        g[:-2] -= DECAY / len(label) * theta[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = {w: float(t) for w, t in zip(chosen, theta[:-2]) if t > 0}
    return Model(weights, float(theta[-2]), min(0.5, float(1 / (1 + np.exp(-theta[-1])))))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and tox_score (0 to 1) and tox_sentences (those that make up the score).

    Texts of any length are scored whole. Null and empty texts get the leak alone; repeated rows get equal
    scores; an empty table gives an empty result. Of the columns of ``docs`` those with the two names are left
    out; to keep them, pack the row into a struct beside ``text``.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MAX_WORDS at most

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for texts in batches:
            got = [of.document(t) for t in texts]
            found = [[{"place": i, "score": p, "text": t} for i, p, t in f] for _, f in got]
            yield pd.DataFrame({"score": [s for s, _ in got], "sentences": found})

    run = F.pandas_udf(score, "score double, sentences array<struct<place:int,score:double,text:string>>")
    scored = docs.select(F.struct("*").alias("row"), run(F.col("text")).alias("found"))
    made = {"tox_score": "score", "tox_sentences": "sentences"}
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in made]
    return scored.select(*own, *[F.col("found")[f].alias(c) for c, f in made.items()])


def held_out(doc_id):
    """Whether a document's label must not be learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1
