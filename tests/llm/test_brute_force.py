"""Every operator's query against plain Python, on the smallest tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import ann, chat_format, common, curriculum, decontaminate, licenses, line_dedup, quality, queries, sharding, simhash, toxicity

LONG = "word " * 30_000
AWKWARD = [None, "", "  \n\t ", "x", LONG, "Same text here.", "Same text here.", "Été à Paris — naïve 😀 text", "a\nb\nThis line is LONG enough\nc", "d\n this line is long enough \ne", "\x00odd\x0bbytes\x1f"]


def low(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def words(s):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(s or ""))


def table(spark, small, name):
    return spark.read.parquet(f"{small}/{name}.parquet")


# ---- sharding ----


def check_shards(rows, docs, n=8):
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < n
    sizes = [len(by[s]) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_shards(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    rows = queries.op1_sharding(spark, small).collect()
    check_shards(rows, docs)
    text, at = dict(docs), {r["doc_id"]: r["shard"] for r in rows}
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(at[i])
    assert all(len(set(g)) == 1 for g in groups.values())  # none is larger than a shard
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_shards_of_awkward_and_crowded_rows(spark, documents):
    check_shards(sharding.shard_documents(documents(AWKWARD)).collect(), list(enumerate(AWKWARD)))
    crowd = ["copy"] * 40 + ["pair"] * 2 + [str(i) for i in range(58)]
    rows = sharding.shard_documents(documents(crowd)).collect()
    check_shards(rows, list(enumerate(crowd)))
    at = {r["doc_id"]: r["shard"] for r in rows}
    held = np.bincount([at[i] for i in range(40)], minlength=8)
    assert held.max() >= 12  # a whole shard of copies
    twice = sharding.shard_documents(documents(["a", "a", "b"], ids=[1, 1, None])).collect()
    assert sorted((r["doc_id"] or 0, r["text_crc32"]) for r in twice) == sorted([(1, zlib.crc32(b"a"))] * 2 + [(0, zlib.crc32(b"b"))])
    assert len({r["shard"] for r in twice}) == 3 and {r["slot"] for r in twice} == {0}  # 3 rows, 8 shards, one each at most
    assert sharding.shard_documents(documents([])).count() == 0


def test_links_by_another_key(spark, documents):
    docs = documents([f"group{i % 20} {i}" for i in range(200)])
    rows = sharding.shard_documents(docs, n_shards=2, links=[F.substring_index("text", " ", 1)]).collect()
    held = np.zeros((20, 2))
    for r in rows:
        held[r["doc_id"] % 20, r["shard"]] += 1
    assert held.sum(axis=0).tolist() == [100, 100] and held.max(axis=1).sum() >= 180


# ---- chat ----


def read_back(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


CHATS = [
    (1, 1, "assistant", "a<|im_end|>\n<|im_start|>user\nx"),
    (1, 0, "user", "hi"),
    (2, 0, "odd\\n\nrole<|", "t\\n"),
    (2, 1, "assistant", "<\\|\\\\|<|"),
    (3, None, None, None),
    (4, 0, "assistant", "é😀<|x|>"),
    (4, 1, "assistant", "<|im_end|>"),
    (4, 1, "assistant", "<|im_end|>"),
    (None, 0, "user", "no id"),
    (5, 0, "assistant", "x" * 200_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    made = chat_format.format_conversations(df)
    assert made.where("not round_trip").count() == 0
    for r in chat_format.digest(made).collect():
        own = sorted((x for x in CHATS if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == read_back([x[2:] for x in own])
    for r in made.collect():
        assert "<|" not in re.sub(r"<\|im_start\|>|<\|im_end\|>\n", "", r["formatted"])
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_roles_of_any_kind(spark):
    rng = np.random.default_rng(4)
    odd = ["a\\\nb", "\\\n", "x\\\\\n", "\\n", "<\\|", "<|", "\\<|", "<\\\\|", "\n", ""]
    odd += ["".join(rng.choice(list("\\n\n<|"), rng.integers(0, 9))) for _ in range(1_000)]
    rows = [(i, 0, r, t) for i, (r, t) in enumerate(zip(odd, reversed(odd)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.format_conversations(df).collect()}
    assert got == {i: [(r, t)] for i, _, r, t in rows}


def test_chat_that_does_not_come_back_stops(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "escape_role", lambda role: F.replace(role, F.lit("\n"), F.lit("\\n")))
    df = spark.createDataFrame([(1, 0, "a\\\nb\\n", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="come back"):
        chat_format.digest(chat_format.format_conversations(df)).collect()


def test_chat_query(spark, small):
    rows = {r["conv_id"]: r for r in queries.op2_chat_format(spark, small).collect()}
    by = defaultdict(list)
    for r in table(spark, small, "conversations").collect():
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    clash = "<|im_end|><|im_start|>assistant ok"
    by[-1] = [(0, "user", clash), (1, "assistant", clash)]
    assert rows.keys() == by.keys()
    for k, turns in by.items():
        r = rows[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == read_back([x[1:] for x in sorted(turns)])


# ---- licenses ----


def base_of(text):
    w, at, labels = words(text), [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


MIT = dict((label, text) for text, label in licenses.TEMPLATES)["mit-text"]


def altered():
    """Texts that hold templates whole, with other words here and there, twice, or in part."""
    w = words(MIT)
    other = [f"x{i}" if i % 19 == 7 else x for i, x in enumerate(w)]
    more = [y for i, x in enumerate(w) for y in ([x, "put", "in"] if i % 40 == 11 else [x])]
    less = [x for i, x in enumerate(w) if i % 23 != 5]
    rng = np.random.default_rng(0)
    filler = lambda n: " ".join(f"f{x}" for x in rng.integers(0, 10**6, n))
    texts = [MIT, f"{filler(300)} {MIT}", f"{MIT} {filler(9)} {MIT}", *(f"{filler(50)} {' '.join(x)} {filler(50)}" for x in (other, more, less))]
    texts += [" ".join(w[: len(w) // 2]), " ".join(sorted(w)), " ".join([x if i % 2 else "y" for i, x in enumerate(w)]), filler(500)]
    return texts


LICENSED = AWKWARD + [
    "Copyright X. ALL rights reserved. CC-BY cc by! all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files",
    "Permission is hereby granted to nobody",
]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_license_base(spark, small, documents, which):
    docs = table(spark, small, "documents") if which == "table" else documents(LICENSED + altered())
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = (queries.op3_licenses(spark, small) if which == "table" else licenses.license_report(docs)).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(text[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    if which == "awkward":
        by = {r["doc_id"]: r for r in rows}
        assert by[len(AWKWARD) + 1]["labels"] == "mit" and by[len(AWKWARD) + 2]["labels"] == ""
        assert licenses.license_report(docs.limit(0)).count() == 0
        twice = licenses.license_report(documents([MIT, MIT, MIT], ids=[1, 1, None])).collect()
        assert len(twice) == 3 and len({r["labels"] for r in twice}) == 1


def common_words(a, b):
    """The length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        before = row.copy()
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return int(row[-1])


def test_license_labels_by_alignment_everywhere(spark, documents):
    """Labels and scores against every window of every text, for two templates given as a table."""
    texts = altered() + ["one two three four five six seven eight nine ten", "a one two three four five SIX, seven eight nine", "one two three four five x y z nine ten", "one two three four five", None]
    known = [(MIT, "mit-text"), ("One two three four five six seven eight nine ten", "ten"), ("!!", "none"), (None, "null"), ("x", None)]
    rows = licenses.license_report(documents(texts), spark.createDataFrame(known, "text string, label string")).collect()
    for r in rows:
        w, labels, best = words(texts[r["doc_id"]]), set(), 0.0
        for text, label in known[:2]:
            t = words(text)
            size = len(t) + 2 * licenses.DRIFT + 8  # words put in
            share = max((common_words(w[i : i + size], t) for i in range(0, max(1, len(w)), 3)), default=0) / len(t)
            whole = any(w[i : i + len(t)] == t for i in range(len(w)))
            best = max(best, share)
            if share >= licenses.COVERAGE:
                labels.add(label)
            assert not whole or r["score"] == 1
        assert set(r["labels"].split(",")) - {""} == labels, (r["doc_id"], r["score"], best)
        if labels:  # the alignment is no better than the best, and nearly as good
            assert best - 0.08 <= r["score"] <= best + 1e-9


def test_license_spans_and_their_grams(spark, documents):
    texts = altered()
    spans = {r["doc_id"]: [s for s in r["spans"] if s["label"] == "mit-text"] for r in licenses.scan_licenses(documents(texts)).collect()}
    n = len(words(MIT))
    assert [(s["first"], s["last"], s["coverage"]) for s in spans[0]] == [(0, n - 1, 1.0)]
    assert [(s["first"], s["last"]) for s in spans[1]] == [(300, 300 + n - 1)]
    assert sorted((s["first"], s["last"], s["verified"]) for s in spans[2]) == [(0, n - 1, True), (n + 9, 2 * n + 8, True)]
    assert [len([s for s in spans[i] if s["verified"]]) for i in (3, 4, 5)] == [1, 1, 1]  # drifting diagonals are one span
    assert not any(s["verified"] for i in (6, 7, 8, 9) for s in spans[i])
    rng = np.random.default_rng(1)
    some = [f"w{x}".encode() for x in rng.integers(0, 50, 200)]
    grams = licenses.rolled(licenses.Hashes().of(some), 3).tolist()
    same = {}
    for i, h in enumerate(grams):
        assert same.setdefault(tuple(some[i : i + 3]), h) == h
    assert len(set(same.values())) == len(same) and len(licenses.rolled(licenses.Hashes().of(some[:2]), 3)) == 0
    with pytest.raises(ValueError, match="words"):
        licenses.scan_licenses(documents(["x"]), templates=spark.createDataFrame([("w " * 200_001, "long")], "text string, label string"))


# ---- near-duplicates ----


def fingerprint(text):
    w = low(text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    ids, root = sorted(fps), {}
    values = np.array([fps[i] for i in ids], dtype=np.uint64)
    for n, i in enumerate(ids):
        if i in root:
            continue
        todo = [n]
        root[i] = i
        while todo:
            near = np.flatnonzero(np.bitwise_count(values ^ values[todo.pop()]) <= 2)
            for j in near:
                if ids[j] not in root:
                    root[ids[j]] = i
                    todo.append(int(j))
    return root


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_near_duplicates(spark, small, documents, which):
    docs = table(spark, small, "documents") if which == "table" else documents(AWKWARD)
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    rows = (queries.op4_simhash(spark, small) if which == "table" else simhash.near_duplicates(docs)).collect()
    want = roots(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{v:016x}", want[i]) for i, v in fps.items()}
    assert which == "table" or simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_among_crowded_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 62, 3)]
    values = set()
    for b in base:  # far more than CROWDED under one key, up to 6 bits apart
        for _ in range(150):
            values.add(b ^ sum(1 << int(x) for x in rng.choice(12, rng.integers(0, 4), replace=False)))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    state = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps)).collect()}
    want = roots({v: v & ((1 << 64) - 1) for v in values})
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({v: state.get(v, v) for v in values}) == groups(want)


def crowded_fingerprints():
    rng = np.random.default_rng(1)
    values = set()
    for b in rng.integers(0, 1 << 62, 3):
        for _ in range(150):
            values.add(int(b) ^ sum(1 << int(x) for x in rng.choice(12, rng.integers(0, 4), replace=False)))
    return sorted(values | {int(x) for x in rng.integers(0, 1 << 62, 300)})


def test_links_are_all_pairs(spark):
    values = np.array(crowded_fingerprints(), dtype=np.int64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    want = {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(near)) if i < j}
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long")
    assert {(r["a"], r["b"]) for r in simhash.links(fps).collect()} == want and len(want) > 500


def test_pivots_decide_the_candidates(spark, monkeypatch):
    values = crowded_fingerprints()
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    far = lambda a, b: max(abs((a ^ p).bit_count() - (b ^ p).bit_count()) for p in simhash.whole_pivots())

    def pairs():
        return {(r["a"], r["b"]): r["apart"] for r in simhash.candidates(fps).collect()}

    many = pairs()
    assert all(v == far(a, b) for (a, b), v in many.items())
    passed = {k for k, v in many.items() if v <= 2}
    links = {k for k in passed if (k[0] ^ k[1]).bit_count() <= 2}
    assert links < passed < many.keys()  # the bound discards some, the distance others
    monkeypatch.setattr(simhash, "CROWDED", 10**9)
    whole = pairs()
    monkeypatch.setattr(simhash, "REFERENCES", 2)
    fewer = pairs()
    assert len(fewer) > 1.5 * len(whole) and whole.keys() > links and fewer.keys() > links
    monkeypatch.setattr(simhash, "WHOLE_PIVOTS", 0)
    assert set(pairs().values()) == {0}


def test_shuffle_branch_of_counted_joins(spark, monkeypatch):
    rows = [(k, i) for i in range(3_000) for k in ([0] if i % 3 == 0 else [i])]
    df = spark.createDataFrame(rows, "key long, x long")
    sizes = df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key % 2 = 0")
    for share in (0, 10, common.HOT_SHARE, 10**9):  # none is hot, one, and all
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = common.join_counted(df, sizes, "key", "n", df.count()).collect()
        assert sorted((r["key"], r["x"]) for r in got) == sorted(r for r in rows if r[0] % 2 == 0)
        assert all(r["n"] == (1_000 if r["key"] == 0 else 1) for r in got)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_a_long_shuffled_chain(spark):
    n = 4_000
    names = [int(x) for x in np.random.default_rng(3).permutation(n)]
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [(n, n + 1), (n + 2, n + 2)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n: n, n + 1: n, n + 2: n + 2}
    assert simhash.components(edges.limit(0)).count() == 0


def test_toxic_words_are_not_cut_at_a_thousand():
    assert toxicity.MAX_WORDS >= 4_096


# ---- mixing ----


def targets(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_mixing(spark, small, documents, which):
    sources = ["b", "a", None, "b", "é", "z", "z", None, "a", "a", "b"]
    docs = table(spark, small, "documents") if which == "table" else documents(AWKWARD, sources=sources)
    own = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.select("doc_id", "source", "text").collect()}
    total = defaultdict(int)
    for s, n in own.values():
        total[s] += n
    want = targets(total)
    mixed = queries.op5_mixing(spark, small) if which == "table" else curriculum.curriculum(docs)
    rows = mixed.collect()
    assert len(rows) == len(own)
    taken = defaultdict(int)
    for r in rows:
        s, n = own[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, total[s]) and r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in total)
    again = queries.op5_mixing(spark, small) if which == "table" else curriculum.curriculum(docs)
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in rows}


def test_training_order_follows_the_schedules(spark, documents):
    docs = documents([f"w{i} " * 10 for i in range(300)], sources=["a", "b", "c"] * 100)
    rows = curriculum.training_order(docs, ["doc_id", "source"]).collect()
    places = [r["position"] for r in rows]
    assert places == sorted(places) and 0 < places[0] and places[-1] <= 1
    early = [r["source"] for r in rows if r["position"] < 0.25]
    late = [r["source"] for r in rows if r["position"] > 0.75]
    assert early.count("a") < late.count("a") and early.count("c") > late.count("c")
    turned = curriculum.training_order(docs, ["doc_id", "source"], schedules={1: (1.5, 0.5), 3: (0.0, 2.0)}).collect()
    early = [r["source"] for r in turned if r["position"] < 0.25]
    late = [r["source"] for r in turned if r["position"] > 0.75]
    assert early.count("a") > late.count("a") and early.count("c") < late.count("c")
    assert sorted((r["doc_id"], r["words"]) for r in rows) == sorted((r["doc_id"], r["words"]) for r in turned)
    # A whole schedule of one copy after the other: positions by bisection of its integral.
    for (a, b), source in (((1.5, 0.5), "a"), ((0.0, 2.0), "c")):
        demand = lambda t, a=a, b=b: (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
        own, at = [r for r in turned if r["source"] == source], 0
        total = sum(r["words"] for r in own)
        for r in own:
            assert demand(r["position"]) == pytest.approx((at + r["words"] / 2) / total, abs=2e-3)
            at += r["words"]
    assert curriculum.curriculum(documents([])).count() == 0


def test_schedules_change_the_order_of_the_query(spark, small, monkeypatch):
    before = [r["doc_id"] for r in queries.op5_mixing(spark, small).collect()]
    monkeypatch.setattr(curriculum, "SCHEDULES", {1: (1.9, 0.1), 2: (0.3, 1.7)})
    after = [r["doc_id"] for r in queries.op5_mixing(spark, small).collect()]
    assert before != after and sorted(before) == sorted(after)


def test_mixing_of_rows_of_one_id(spark, documents):
    docs = documents([f"w{i} " * 10 for i in range(50)] + ["same text here"] * 10, ids=[None] * 30 + [7] * 30, sources=["a"] * 60)
    rows = curriculum.curriculum(docs, ["doc_id", "size"]).collect()
    assert sum(r["taken"] for r in rows) == 530 and len(rows) == 60 and {r["size"] for r in rows} == {"x"}
    again = curriculum.curriculum(docs, ["doc_id", "size"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert curriculum.curriculum(docs.withColumn("mix_size", F.lit("y")), ["size", "mix_size", "copies"]).columns == [
        "size", "mix_size", "copies", "mix_mix_size", "source_size", "target", "mix_copies", "taken"
    ]


# ---- decontamination ----


def contamination(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9)):
            if w:
                wins[tuple(w[a : a + 10])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[k]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    want = contamination(docs, items)
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op6_decontamination(spark, small).collect()} == want


def test_decontamination_of_awkward_rows(spark, documents):
    item = "One two THREE four five six seven eight nine ten eleven twelve"
    texts = AWKWARD + [f"x {item.lower()} y", f"{item} {item}", "two three four five six seven eight nine ten ELEVEN", "ÉTÉ", "été", "short item", "short, item: short item"]
    items = [(1, item), (2, "short ITEM"), (3, None), (4, ""), (5, "Été"), (None, "three four five six seven eight nine ten eleven twelve"), (1, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(texts)
    want = contamination(list(enumerate(texts)), [("null" if i is None else i, t) for i, t in items])
    got = decontaminate.decontaminate(docs, bench).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in got} == {i: v[:3] for i, v in want.items()}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    same = decontaminate.decontaminate(documents([item, item, "x"], ids=[7, 7, 7]), bench.limit(1)).collect()
    assert sorted(r["n_hit"] for r in same) == [0, 12, 12]


def test_decontamination_without_a_broadcast(spark, documents, monkeypatch):
    """By a shuffle, with items of all lengths and one word that makes up nine in ten."""
    item = "One two THREE four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "the the"), (3, "the"), (4, "the the the the the the the the the the the one"), (5, "Seven"), (6, "été d'été")]
    rng = np.random.default_rng(8)
    texts = [item, f"a {item} b", "none", None, "", "the", "The THE end", "x seven", "l'été d ÉTÉ d été"]
    texts += [" ".join(rng.choice(["the", "one", "w"], 300, p=[0.9, 0.05, 0.05])) for _ in range(30)] + ["the " * 20_000 + item]
    docs, bench = documents(texts), spark.createDataFrame(items, "item_id long, text string")
    want = {i: v[:3] for i, v in contamination(list(enumerate(texts)), items).items()}
    for windows in (decontaminate.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
        got = decontaminate.decontaminate(docs, bench).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in got} == want


def test_hot_shingles_are_dealt_to_many_tasks(spark, documents):
    docs = documents(["the " * 400 + str(i) for i in range(50)])
    bench = spark.createDataFrame([(1, "the the the")], "item_id long, text string")
    index = decontaminate.prefixes(docs, decontaminate.windows(bench), False)
    met = decontaminate._met_by_shuffle(docs, index, False)
    assert met.count() == 50 * 399
    salts = [r["count"] for r in met.groupBy("_salt").count().collect()]
    assert len(salts) == decontaminate.SALTS and max(salts) < 3 * 50 * 399 / decontaminate.SALTS


# ---- nearest neighbours ----


def nearest(ids, x, i, k=5):
    """(id, cosine) of the k nearest rows but row i, ties to the smaller id, null last."""
    norms = np.sqrt((x * x).sum(axis=1))
    s = (x * x[i]).sum(axis=1) / (norms * norms[i])
    order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j] is None, ids[j] or 0))[:k]
    return [(ids[j], float(s[j])) for j in order]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_query(spark, sf, monkeypatch):
    fitted = []
    own = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: fitted.append(own(*a)) or fitted[0])
    rows = table(spark, f"/root/testdata/{sf}", "embeddings").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = defaultdict(list)
    for r in queries.op7_ann(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert len(fitted[0].centroids) > 5  # at every size
    hits = n = 0
    for i in [i for i, v in enumerate(ids) if v % 50 == 0]:
        mine = got.pop(ids[i])
        assert len(mine) == 5 and [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        hits += len({v for v, _ in mine} & {v for v, _ in nearest(ids, x, i)})
        n += 5
        exact = dict(nearest(ids, x, i, len(ids)))
        assert all(s == pytest.approx(exact[v], abs=1e-12) for v, s in mine)
    assert not got and hits / n >= 0.9


def crowd(n=600, dims=24):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, dims)) + 2 * rng.standard_normal((6, dims))[rng.integers(0, 6, n)]
    x[100:300] = x[100]  # of one vector
    return x


def test_neighbours_in_many_lists_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTORS_PER_GROUP", 64)
    monkeypatch.setattr(ann, "QUERIES_PER_GROUP", 4)
    monkeypatch.setattr(ann, "PAIRS", 256)
    x = crowd()
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = {i: [v for v, _ in nearest(list(range(600)), x, i)] for i in range(0, 600, 20)}
    assert got[100] == [101, 102, 103, 104, 105] and got[120] == [100, 101, 102, 103, 104]
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) >= 0.9 * 5 * len(want)


def test_bounds_abandon_candidates_but_no_neighbour():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tx, own = x.astype(np.float32), np.arange(3_000)[None, :] == np.arange(40)[:, None]
    exact = ((x[:40, None] - x[None]) ** 2).sum(axis=2)
    exact[own] = np.inf
    best = np.argsort(exact, axis=1)[:, :5]
    left = []
    for bound in (np.full(40, np.inf), np.sort(exact, axis=1)[:, 4] + 1e-6):
        qi, xi = ann.survivors(tx, tx[:40], own, bound, 5)
        pairs = set(zip(qi.tolist(), xi.tolist()))
        assert sum((i, int(j)) in pairs for i in range(40) for j in best[i]) >= 0.98 * 200
        assert not any(i == j for i, j in pairs)
        left.append(len(pairs))
    assert left[1] <= left[0] < 0.1 * own.size  # a known bound abandons more


def test_neighbours_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 0.995037), (2, 1, 0.0), (3, 2, 0.0)]
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(twice, F.col("vec_id") % 50 == 0).collect())
    assert len(got) == 9 and sum(v == 50 for _, _, v in got) == 6


def test_neighbours_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit(1), "rid": F.lit(2), "v": F.lit("x"), "q": F.lit(0)})
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, None), (0, 3, 7), (0, 4, 7), (50, 1, 0), (50, 2, None), (50, 3, 7), (50, 4, 7)]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    long = spark.createDataFrame([(50, [1.0] * 5_000), (1, [1.0] * 4_999 + [2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.search(long, F.col("vec_id") % 50 == 0).collect()] == [1]


# ---- toxicity ----


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    test = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    caught = sum(p for t, p in test if t == 1) / sum(t for t, _ in test)
    wrong = sum(p for t, p in test if t == 0) / sum(1 - t for t, _ in test)
    assert caught >= 0.7 and wrong <= 0.01


def test_toxic_sentences_are_found(spark, documents):
    clean = [f"alpha{i} beta gamma. delta{i} epsilon" for i in range(60)]
    toxic = [f"alpha{i} beta gamma. you utter vermin{'' if i % 2 else 's'} {i}. end{i}" for i in range(60)]
    docs = documents(clean + toxic + AWKWARD)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert rows.count() == 120
    model = toxicity.fit(rows)
    got = toxicity.score_documents(docs, model).select("doc_id", "tox_score", "tox_sentences").collect()
    assert len(got) == 120 + len(AWKWARD) and all(0 <= r["tox_score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] >= 60 and len(r["tox_sentences"]):
            assert "vermin" in r["tox_sentences"][0]["text"] and r["tox_score"] >= 0.7
    assert sum(r["tox_score"] < 0.7 for r in got if r["doc_id"] < 60) >= 60
    assert toxicity.fit(rows.limit(0)).weights == {} and toxicity.score_documents(docs.limit(0), model).count() == 0


def noisy_or(model, text):
    """The score as the docstring of the module says it, sentence by sentence."""
    none = 1 - model.leak
    for sentence in re.split(r"[.!?\n]", low(text or "")):
        known = [w for w in set(words(sentence)) if w in model.weights]
        if known:
            none *= 1 - 1 / (1 + np.exp(-model.bias - sum(model.weights[w] for w in known)))
    return 1 - none


def test_toxicity_scores_are_noisy_or(spark, documents):
    model = toxicity.Model({"vermin": 2.5, "utter": 0.7, "été": 1.1}, -1.2, 0.03)
    texts = AWKWARD + ["Utter VERMIN! vermin. utter? calm\nvermin vermin été", "utter utter. utter", "vermin." * 50]
    rows = toxicity.score_documents(documents(texts), model).select("doc_id", "tox_score").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["tox_score"] == pytest.approx(noisy_or(model, texts[r["doc_id"]]), abs=1e-12)


def test_toxicity_gradient():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 12, 30))
    bag_of = np.sort(rng.integers(0, 30, 60))
    bags = toxicity.Bags(rng.integers(0, 2, 12), doc, bag_of, rng.integers(0, 5, 60), 5)
    theta = rng.normal(0, 0.5, 7)
    value, gradient = bags.likelihood(theta)
    q, plain = 1 / (1 + np.exp(-theta[-1])), 0.0
    for d, y in enumerate(bags.label):
        none = 1 - q
        for b in np.flatnonzero(doc == d):
            none *= 1 - 1 / (1 + np.exp(-theta[-2] - sum(theta[w] for w in bags.word_of[bag_of == b])))
        plain += np.log(1 - none if y else none) / 12
    assert value == pytest.approx(plain, abs=1e-12)
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        slope = (bags.likelihood(theta + step)[0] - bags.likelihood(theta - step)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-6)


def test_toxicity_training_rows_are_bounded(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 50)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1_000)] + [(7, 1), (7, 0)], "doc_id long, toxic int")
    docs = documents([f"text {i}" for i in range(1_000)] + ["b", "a"] * 300, ids=[*range(1_000)] + [7] * 600)
    rows = toxicity.training_rows(docs, labels).collect()
    assert 20 < len(rows) < 90 and len({r["id"] for r in rows}) == len(rows)
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 5_000)
    seven = [tuple(r) for r in toxicity.training_rows(docs, labels).collect() if r["id"] == 7]
    assert seven == [(7, "a", 1)]


# ---- quality ----


def test_quality_posteriors_by_document():
    """EM with a row per document, not per pattern of votes, in plain Python."""
    rng = np.random.default_rng(0)
    n = len(quality.LABELLERS)
    seen = [[int(x) for x in rng.choice(3, n, p=[0.1, 0.1, 0.8] if i % 4 else [0.2, 0.5, 0.3])] for i in range(120)]
    pattern = [sum(v * 3**j for j, v in enumerate(row)) for row in seen]
    counts = defaultdict(int)
    for p in pattern:
        counts[p] += 1
    got = quality.estimate(dict(counts), rounds=25)
    prior = [[0.10, 0.02, 0.88], [0.20, 0.40, 0.40]]
    chance = [[list(prior[c]) for _ in range(n)] for c in (0, 1)]
    share = 0.8
    for _ in range(25):
        post = []
        for row in seen:
            a, b = share, 1 - share
            for j, v in enumerate(row):
                a, b = a * chance[0][j][v], b * chance[1][j][v]
            post.append(a / (a + b))
        share = min(0.99, max(0.5, sum(post) / len(post)))
        for c in (0, 1):
            for j in range(n):
                held = [5 * x for x in prior[c]]
                for row, p in zip(seen, post):
                    held[row[j]] += p if c == 0 else 1 - p
                chance[c][j] = [x / sum(held) for x in held]
    for p, x in zip(pattern, post):
        assert got[p] == pytest.approx(x, abs=1e-9)


def test_quality_scores_are_those_of_the_scorer(spark, documents):
    texts = AWKWARD + ["Plain words in a row. And some more of them.", "| | | ##", "A!! B!! c!! d!! e!!"]
    scorer, posterior = quality.fit(documents(texts))
    rows = quality.assess(documents(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        at, x = quality.features(texts[r["doc_id"]])
        z = scorer.bias + sum(scorer.weights[i] * v for i, v in zip(at, x))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r["keep"] == (r["score"] >= 0.5)
        assert r["posterior"] == pytest.approx(posterior[r["pattern"]], abs=1e-9)


def test_quality_samples_repeated_rows_one_by_one(spark, documents, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_DOCS", 200)
    docs = documents(["the same text again and again"] * 1_000 + [f"other text number {i}" for i in range(1_000)], ids=[1] * 1_000 + [*range(1_000)])
    n = [r["count"] for r in quality.sample(docs, 2_000).groupBy(F.size("slots").alias("s")).count().collect()]
    assert 140 < sum(n) < 260
    some = quality.sample(docs.where("doc_id = 1 and text like 'the same%'"), 1_000).count()
    assert 140 < some < 260


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, d).collect()
    test = [(label[r["doc_id"]], r["keep"]) for r in rows if r["doc_id"] in label]
    assert sum(k for q, k in test if q == 1) / sum(q for q, _ in test) >= 0.97
    assert sum(not k for q, k in test if q == 0) / sum(1 - q for q, _ in test) >= 0.9


def test_quality_of_awkward_rows(spark, documents):
    rows = quality.assess(documents(AWKWARD + AWKWARD, ids=list(range(11)) * 2)).collect()
    assert len(rows) == 22 and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert len({(r["doc_id"], r["score"]) for r in rows}) == 11
    assert quality.assess(documents([])).count() == 0


# ---- lines ----


def lines_of(docs):
    own = defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                own[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(own.get(key(x), ())) < 2 or min(own[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("bits", [30, 6])
def test_lines(spark, small, documents, bits, monkeypatch):
    if bits < 19:  # full filters, many prefixes, hashes sent in parts
        for name, value in {"MIN_LOG_BITS": 12, "MAX_LOG_BITS": bits, "BITS_PER_LINE": 1, "PREFIX_LINES": 4, "HELD": 50}.items():
            monkeypatch.setattr(line_dedup, name, value)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, k, n, g in lines_of(docs)}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op10_line_dedup(spark, small).collect()} == want


def test_repeats_alone_are_in_the_filter(spark, documents):
    lines = [f"a line of its own, number {i}" for i in range(4_000)]
    docs = documents(["\n".join(lines[i : i + 40]) for i in range(0, 4_000, 40)] + ["\n".join(lines[:400:10])])
    log_bits, bits = line_dedup.twice_filter(docs)
    seen = line_dedup.Bloom(log_bits, bits)
    has = seen.has(np.array([xxhash.xxh64_intdigest(x.encode()) for x in lines], dtype=np.uint64))
    assert has[:400:10].all() and has.sum() < 40 + 200


def test_documents_without_suspects_are_not_shuffled(spark, documents):
    docs = documents(["only here, a line\nand another one", None, "found in two texts\nx", "found in two texts"])
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 3 and "Union" in plan
    biggest = line_dedup.dedup_lines(documents(["a line of text", "a line of text"], ids=[None, (1 << 63) - 1])).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in biggest} == {None: 1, (1 << 63) - 1: 0}


def test_lines_of_awkward_rows(spark, documents):
    texts = AWKWARD + ["ÀÀÀÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀÀ", "twice in one\nTWICE in one", "\ttwice in one\r"]
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(documents(texts)).collect())
    assert got == lines_of(list(enumerate(texts)))
    same = [(1, "one line of text"), (1, "one line of text"), (2, "one line of text\nmore")]
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(documents([t for _, t in same], ids=[i for i, _ in same])).collect())
    assert got == lines_of(same)
    assert line_dedup.dedup_lines(documents([])).count() == 0
    ids = line_dedup.dedup_lines(documents(["a line of text", "a line of text"], ids=[None, 5])).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in ids} == {None: 1, 5: 0}
