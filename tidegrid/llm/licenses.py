"""License scans by diagonal voting.

All word k-grams of a text are rolled over and hashed. A Spark join brings each to the template positions with
that hash, and its diagonal, the place in the text less the place in the template, gets a vote. Neighbouring
diagonals, as left by words put in or left out, are merged. A merged diagonal with enough votes is verified: the
words between its ends are aligned with the template's, and it is a license span if enough of these are met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import cut
from tidegrid.llm.license_texts import BASE, TEMPLATES

#: Words of a gram of the templates; shorter templates and all base phrases are one gram.
GRAM = 5
#: Diagonals that differ by so many words at most are merged.
DRIFT = 3
#: Share of a template's words that the grams of a merged diagonal cover at least, to be verified; and that
#: a license span meets in the template's order.
VOTED, COVERAGE = 0.3, 0.8
#: The templates are broadcast, and may have so many words in all.
MAX_TEMPLATE_WORDS = 200_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Hashes(dict):
    """The hash of each word, kept for the words met again; emptied when it gets large."""

    MOST = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(each: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-gram of words with the hashes ``each``."""
    n = max(0, len(each) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out * _FACTOR) + (each[i : i + n] ^ (out >> np.uint64(29)))
    return out


def default_templates(spark: SparkSession) -> DataFrame:
    """(text, label) of the licenses and notices of license_texts.py."""
    return spark.createDataFrame(TEMPLATES, "text string, label string")


def _known(templates: DataFrame | None) -> list[tuple[list[bytes], str, bool]]:
    """(words, label, whether a base phrase) of all templates; those without words, and repeats, are left out."""
    rows = TEMPLATES if templates is None else [(r["text"], r["label"]) for r in templates.select("text", "label").limit(MAX_TEMPLATE_WORDS + 1).collect()]
    out = [(words_of(t), label, True) for t, label in BASE]
    for text, label in sorted(set(rows), key=str):
        if label and words_of(text):
            out.append((words_of(text), label, False))
    if sum(len(w) for w, _, _ in out) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    return out


def _gram(words: list[bytes], base: bool) -> int:
    return len(words) if base else min(GRAM, len(words))


def _scanner(lengths: list[int]):
    """Rows of the hashes of all grams: those of the first length by place, then those of the next, and so on."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                texts = [words_of(t) for t in part["text"]]
                each = np.concatenate([hashes.of(w) for w in texts])
                whole = [(k, rolled(each, k).view(np.int64)) for k in lengths]  # those across two texts aren't used
                ends = np.cumsum([len(w) for w in texts]).tolist()
                grams = [np.concatenate([h[end - len(w) : max(end - len(w), end - k + 1)] for k, h in whole]) for w, end in zip(texts, ends)]
                yield part.drop(columns="text").assign(n_words=[len(w) for w in texts], grams=pd.Series(grams, part.index, object))

    return scan


def _aligned(words: list[bytes], template: list[bytes], begin: int, end: int) -> tuple[float, int, int]:
    """(share of the template's words met in order, first and last of them) near words ``begin`` to ``end``."""
    lo, hi = max(0, begin - DRIFT), min(len(words), end + DRIFT)
    if words[max(0, begin) : end] == template:
        return 1.0, begin, end - 1
    blocks = [b for b in SequenceMatcher(None, words[lo:hi], template, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, lo, lo
    return sum(b.size for b in blocks) / len(template), lo + blocks[0].a, lo + blocks[-1].a + blocks[-1].size - 1


SPAN = "struct<label:string,base:boolean,first:int,last:int,coverage:double,verified:boolean>"


def _verifier(known: list[tuple[list[bytes], str, bool]]):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, spans = [], []
            for text, found in zip(batch["text"], batch["found"]):
                words = words_of(text)
                n_words.append(len(words))
                made = []
                for f in found if found is not None else []:
                    template, label, base = known[f["template"]]
                    share, first, last = _aligned(words, template, f["begin"], f["end"])
                    if not base or share == 1:
                        made.append({"label": label, "base": base, "first": first, "last": last, "coverage": share, "verified": share >= COVERAGE})
                spans.append(made)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n_words, "spans": spans})

    return verify


def merged_diagonals(docs: DataFrame, known: list[tuple[list[bytes], str, bool]]) -> DataFrame:
    """(doc_id, h, template, begin, end, voted): where templates may stand, in words from 0, end excluded.

    h: the text's hash. voted: the share of the template's words that the grams voted for cover.
    """
    spark = docs.sparkSession
    lengths = sorted({_gram(w, base) for w, _, base in known})
    places, hashes = [], Hashes()
    for i, (words, _, base) in enumerate(known):
        k = _gram(words, base)
        places += [(i, base, at, k, len(words), int(h)) for at, h in enumerate(rolled(hashes.of(words), k).view(np.int64))]
    table = spark.createDataFrame(places, "template int, base boolean, place int, k int, size int, gram long")  # MAX_TEMPLATE_WORDS at most
    read = docs.mapInPandas(_scanner(lengths), "doc_id long, h long, n_words int, grams array<long>")
    votes = read.select("doc_id", "h", "n_words", F.posexplode("grams").alias("_pos", "gram")).join(F.broadcast(table), "gram")
    before = sum((F.when(F.col("k") > k, F.greatest(F.col("n_words") - k + 1, F.lit(0))).otherwise(0) for k in lengths), F.lit(0))
    doc = ["doc_id", "h"]
    lines = votes.groupBy(*doc, "template", "base", "k", "size", (F.col("_pos") - before - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")
    )
    order = Window.partitionBy(*doc, "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(order), F.col("diagonal") - DRIFT - 1) > DRIFT)
    runs = lines.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(order))
    covered = F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda p: F.sequence(p, p + F.col("k") - 1)))
    merged = runs.groupBy(*doc, "template", "k", "size", "_run").agg(
        F.min("diagonal").alias("begin"), (F.max("diagonal") + F.col("size")).cast("int").alias("end"), F.size(F.array_distinct(covered)).alias("_n")
    )
    voted = F.col("_n") / F.col("size")
    return merged.where(voted >= VOTED).select(*doc, "template", F.col("begin").cast("int").alias("begin"), "end", voted.alias("voted"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", templates: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_words, spans (label, base, first, last, coverage, verified).

    templates: (text, label), texts of any length up to MAX_TEMPLATE_WORDS in all; by default those of
    license_texts.py. Null or wordless templates, null labels and repeats don't count. first and last are words
    from 0. coverage (0 to 1): the share of a template's words that the span meets in their order; a base
    span is an exact occurrence of a phrase. Texts of any length are read whole; null texts have no words;
    repeated rows get equal results; an empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    known = _known(templates)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    spans = cut(merged_diagonals(rows, known), "license-spans")
    each = spans.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("template", "begin", "end"))).alias("found"))
    met = rows.join(each, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return met.select("doc_id", "text", "found").mapInPandas(_verifier(known), f"doc_id long, n_words long, spans array<{SPAN}>")


def license_report(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest coverage of any template or phrase in the text, 0 without any. labels holds those of
    base phrases and of verified spans. See ``scan_licenses`` for nulls, repeated rows and empty tables.
    """
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"].cast("long"))
    return scan_licenses(docs, templates=templates).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.filter("spans", lambda s: s["verified"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
