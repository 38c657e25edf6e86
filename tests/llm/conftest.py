import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(texts, ids=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        sources = sources or [None] * len(texts)
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
        # Names that the operators use inside, to show that they don't clash.
        return spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "h": F.lit(1), "_h": F.lit(2), "rid": F.lit(3), "key": F.lit("k"), "pattern": F.lit(9), "copies": F.lit(1), "target": F.lit("t"), "_id": F.lit(0), "_tox": F.lit(1), "tox_score": F.lit(77), "_c": F.lit(1), "mix_size": F.lit(2), "_row": F.lit(5), "row": F.lit(6), "copy": F.lit("c"), "position": F.lit(8), "_doc": F.lit(1), "shard": F.lit("s"), "slot": F.lit(3)})

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
