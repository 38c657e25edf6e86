"""Each stage of the pipeline on its own input, and all of them in a row."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm import curriculum, queries, shingles, simhash

SMALL = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]


def test_near_dedup_keeps_one_of_a_group(spark, documents):
    docs = documents(["same words here", "Same WORDS here", "other words altogether", None, "", "same words here"], ids=[4, 2, 7, 1, 9, 4])
    docs = docs.unionByName(documents(["no id", "no id"], ids=[None, None]))
    kept = stage("simhash_near_dedup")(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "no id"), (1, None), (2, "Same WORDS here"), (7, "other words altogether")]


def test_near_dedup_drops_similar_texts_of_many_bits(spark, documents):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5_000, 200)]
        near = [*words[:60], "other", *words[61:120], "another", *words[121:]]  # 10 of 196 shingles differ
        texts += [" ".join(words), " ".join(near)]
    bits = [(simhash.fingerprint_bytes(a.encode()) ^ simhash.fingerprint_bytes(b.encode())).bit_count() for a, b in zip(texts[::2], texts[1::2])]
    assert max(bits) > 2
    kept = stage("simhash_near_dedup")(spark, documents(texts), SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))


def jaccard(a, b):
    a, b = (set(shingles.shingle_hashes(t.encode()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_of_a_crowd_with_a_common_passage(spark, documents, monkeypatch):
    """Texts that share most of a passage, so that they have keys in common, in pairs that alone are similar."""
    monkeypatch.setattr(shingles, "CROWDED", 1)
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(150)]
    texts = []
    for _ in range(30):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        texts += [" ".join(common + own), " ".join([*common, *own[:55], "x", *own[56:]])]
    n = len(texts)
    sims = np.array([[jaccard(a, b) for b in texts] for a in texts])
    bits = [simhash.fingerprint_bytes(t.encode()) for t in texts]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if sims[i, j] >= 0.8 or (bits[i] ^ bits[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert 10 < len(set(root)) < n
    kept = stage("simhash_near_dedup")(spark, documents(texts), SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    # Where nothing is linked yet, the prefix join finds every similar pair of a crowd, but not all pairs.
    docs = documents(texts)
    classes = shingles.sketches(docs).cache()
    named = {r["class"]: r["doc_id"] for r in classes.collect()}
    nothing = spark.createDataFrame([], "node long, root long")
    left = shingles._open(shingles._sharing(classes), nothing)
    sets = shingles.sets_of(docs, classes, left.select("class"))
    found = {frozenset((named[r["a"]], named[r["b"]])) for r in shingles._apart(left, sets).collect()}
    want = {frozenset((i, j)) for i in range(n) for j in range(i) if sims[i, j] >= 0.8}
    assert want <= found and len(found) < n * (n - 1) / 4


def test_near_copies_that_are_not_similar_make_few_pairs(spark, documents):
    """Copies of one text, each altered so much that few are similar: almost all share rare shingles."""
    rng = np.random.default_rng(7)
    base, texts = [f"c{i}" for i in range(150)], []
    for i in range(150):
        words = list(base)
        for k in rng.choice(150, 1 + i % 6, replace=False):
            words[k] = f"own{i}x{k}"
        texts.append(" ".join(words[: 150 - i % 4]))
    n, docs = len(texts), documents(texts)
    classes = shingles.sketches(docs).cache()
    named = {r["class"]: r["doc_id"] for r in classes.collect()}
    left = classes.select("class", F.col("class").alias("root"))
    found = {frozenset((named[r["a"]], named[r["b"]])) for r in shingles._apart(left, shingles.sets_of(docs, classes, left.select("class"))).collect()}
    sims = {frozenset((i, j)): jaccard(texts[i], texts[j]) for i in range(n) for j in range(i)}
    want = {p for p, s in sims.items() if s >= 0.8}
    assert len(want) > 500 and want <= found and len(found) < 2 * len(want)


def test_odd_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = (rng.integers(0, 400, rng.integers(0, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        apart = int(np.bitwise_count(shingles.odd_sketch(a) ^ shingles.odd_sketch(b)).sum())
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_near_dedup_keeps_other_texts_of_a_doc_id(spark, documents):
    docs = documents(["one text of its own", "quite other words are here", "quite other words are here"], ids=[1, 1, None])
    kept = stage("simhash_near_dedup")(spark, docs, SMALL)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "one text of its own"), (1, "quite other words are here")]


def test_decontamination_drops_hits_alone(spark, documents):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where(F.length("text") > 100).first()["text"]
    docs = documents(["clean words", f"before {item} after", None, ""])
    kept = stage("benchmark_decontamination")(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == docs.columns


def test_mixing_repeats_and_drops(spark, documents):
    texts = ["w " * 10] * 30 + ["v " * 40] * 30
    docs = documents(texts, sources=["a"] * 30 + ["b"] * 30)
    out = stage("mixing")(spark, docs, SMALL)
    words = {"a": 0, "b": 0}
    for r in out.collect():
        words[r["source"]] += len(re.findall(r"\S+", r["text"]))
    assert out.columns == docs.columns and abs(words["a"] - 500) <= 10 and abs(words["b"] - 1000) <= 40


def test_mixing_writes_copies_in_the_order_of_training(spark, documents):
    docs = documents([f"w{i} " * 10 for i in range(300)], sources=["a", "b", "c"] * 100)
    places = {}
    for r in curriculum.curriculum(docs, ["doc_id"]).collect():
        places[r["doc_id"]] = [c["position"] for c in r["copies"] if c["words"] * 2 >= r["size"]]
    got = [r["doc_id"] for r in stage("mixing")(spark, docs, SMALL).collect()]
    assert got == [i for _, i in sorted((p, i) for i, ps in places.items() for p in ps)]


def test_op5_gives_all_positions_in_order(spark):
    rows = queries.op5_mixing(spark, SMALL).collect()
    taken = [r for r in rows if r["taken"]]
    assert rows[: len(taken)] == taken and [r["position_1"] for r in taken] == sorted(r["position_1"] for r in taken)
    assert any(r["position_3"] for r in rows)
    assert all([x for x in r[-3:] if x is not None] == sorted(x for x in r[-3:] if x is not None) for r in taken)


def test_schedules_change_the_order_of_the_stage(spark, documents, monkeypatch):
    docs = documents([f"w{i} " * 10 for i in range(300)], sources=["a", "b", "c"] * 100)
    before = [r["doc_id"] for r in stage("mixing")(spark, docs, SMALL).collect()]
    monkeypatch.setattr(curriculum, "SCHEDULES", {1: (1.9, 0.1), 2: (0.3, 1.7)})
    after = [r["doc_id"] for r in stage("mixing")(spark, docs, SMALL).collect()]
    assert before != after and sorted(before) == sorted(after)


AWKWARD = [None, "", " \n", "word " * 30_000, "Same text here.", "Same text here.", "Été à Paris, 😀", "\x00odd\x0bbytes"]


def test_toxicity_stage(spark, documents, tmp_path):
    clean = [f"alpha{i} beta gamma. delta{i} epsilon" for i in range(60)]
    toxic = [f"alpha{i} beta gamma. you utter vermin {i}. end{i}" for i in range(60)]
    texts = clean + toxic + AWKWARD
    docs = documents(texts)
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    kept = stage("toxicity")(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == [*range(60), *range(120, len(texts))]
    assert all((r["text"], r["tox_score"], r["_tox"], r["row"]) == (texts[r["doc_id"]], 77, 1, 6) for r in rows)


def test_sharding_stage(spark, documents):
    rows = stage("sharding")(spark, documents(AWKWARD * 5), SMALL).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert len(rows) == 40 and set(sizes) == {5}
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(5)) for s in range(8))


def test_all_stages_of_awkward_rows(spark, documents):
    ids = [*range(len(AWKWARD)), *[None] * len(AWKWARD)]
    docs = documents(AWKWARD * 2, ids=ids, sources=(["a", None, "b", "a"] * 4))
    for name, f in corpus_pipeline.STAGES[:4]:
        kept = f(spark, docs, SMALL)
        rows = kept.collect()
        assert kept.columns == docs.columns, name
        assert {(r["doc_id"], r["text"], r["size"], r["_c"], r["mix_size"]) for r in rows} <= {(i, t, "x", 1, 2) for i, t in zip(ids, AWKWARD * 2)}, name
        if name in ("toxicity", "benchmark_decontamination"):
            assert len(rows) == len(ids), name
    assert f is not None and {r["text"] for r in rows} == {t for t in AWKWARD if (t or "").split()}  # all words are taken somewhere


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert len(rows) > 100 and max(sizes) - min(sizes) <= 1
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in rows)
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SMALL).count() == 0, name
