"""A training corpus in five stages, each of which writes its documents before the next reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import curriculum, decontaminate, sharding, shingles, toxicity
from tidegrid.llm.common import cut


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """(row, ...): all columns as one struct, so that none has the name of one made beside it."""
    return docs.select(F.struct("*").alias("row"), *more)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity is THRESHOLD or more.

    Null and empty texts get the model's leak, which is less, and stay; rows of equal texts go or stay
    together; texts of any length are read whole; without rows, or without labels of both kinds, none is
    dropped; all columns stay as they are, whatever their names.
    """
    rows = toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.held_out)
    scored = toxicity.score_documents(_packed(docs, F.col("text")), toxicity.fit(rows))
    return scored.where(F.col("tox_score") < toxicity.THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each group of near-duplicates; of repeated rows, one.

    Rows are near-duplicates at 0.8 of their five-word shingles or at two bits of op4's fingerprints. They are
    told apart by doc_id and text, so other texts of a doc_id stay; ties of a doc_id go by the row's digest;
    a row without a doc_id comes last. Null, empty and wordless texts are one group. Texts of any length are
    read whole; an empty table gives an empty one; all columns stay as they are, whatever their names.
    """
    first = cut(shingles.survivors(docs), "near-first")
    # One shuffle of the texts, by row key, serves the join and the repeated rows.
    keyed = _packed(docs, shingles.row_key().alias("_row"))
    return keyed.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a window of a benchmark item.

    Null and empty texts hold none; rows of one doc_id are told apart by their texts, and repeated rows go or
    stay together; texts of any length are read whole; with an empty table or benchmark nothing is dropped;
    all columns stay as they are, whatever their names.
    """
    found, _ = decontaminate.occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = cut(found.select(F.col("doc_id").alias("_id"), F.col("_h")).distinct(), "decon-bad")
    keyed = _packed(docs, F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h"))
    return keyed.join(bad, same, "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the curriculum takes, whole documents only, in the order of training.

    Null, empty and wordless texts have no words and are never taken; a null source is one of its own; rows
    without a doc_id go by their texts; repeated rows are documents of their own; texts of any length count
    whole; an empty table gives an empty one; all columns stay as they are, whatever their names.
    """
    return curriculum.whole_copies(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; texts stay with the documents, by doc_id.

    Null texts have size 1; repeated rows are documents of their own and, like all equal texts, go to one
    shard while it has room; a null doc_id comes first; texts of any length are one row each; an empty table
    gives an empty one; other columns are ignored, whatever their names.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", non_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", shards),
]

#: The first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
