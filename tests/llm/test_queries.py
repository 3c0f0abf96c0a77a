"""The registered queries against SQL and brute force, and the pipeline stage by stage on a small folder of tables."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import PLAIN, cut_by_hand, prose, valid

import corpus_pipeline
from lumenfold.llm import mixing, pii, quality, queries

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_held_out_and_digests(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name, m, rest in (("op8_language_id", 4, 2), ("op9_quality", 5, 0)):
        got = queries.QUERIES[name](spark, SF).collect()
        assert len(got) == len(docs) and all(r["held_out"] == (crc(r["doc_id"], m) == rest) and 0 <= r["score"] <= 1 for r in got)
    for r in queries.op10_pii(spark, SF).collect():
        text = docs[r["doc_id"]]["text"] or ""
        want = [f"{k}:{x.start()}:{x.end()}" for k, p in PLAIN for x in re.finditer(p, text) if valid(k, x.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k, _ in PLAIN] == [sum(w.startswith(k) for w in want) for k, _ in PLAIN]
    sources = {}
    for r in queries.op3_source_mix(spark, SF).collect():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or ""))
        assert r["size"] == size and r["taken"] in (0, size, 2 * size, 3 * size)
        sources.setdefault(docs[r["doc_id"]]["source"], []).append((r["size"], r["target"], r["taken"], r["source_size"]))
    assert all(sum(x[0] for x in own) == own[0][3] and abs(sum(x[2] for x in own) - own[0][1]) <= max(x[0] for x in own) for own in sources.values())


def test_chat_marker(spark):
    got = {r["conv_id"]: r for r in queries.op4_chat_format(spark, SF).collect()}
    marker = "</s>[INST] ok [/INST]"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(marker) and got[-1]["loss_sha256"] == hashlib.sha256(marker.encode()).hexdigest()


def test_lm_tokens(spark):
    ascii_lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    docs = {r["doc_id"]: ascii_lower(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {w for i, t in docs.items() if crc(i, 7) != 2 for w in split(t)}
    total = sum(len(split(t)) + 1 for i, t in docs.items() if crc(i, 7) != 2)
    for r in queries.op2_lm_score(spark, SF).collect():
        words = split(docs[r["doc_id"]])
        assert r["n_tokens"] == len(words) + 1 and r["n_known"] == 1 + sum(w in seen for w in words) and r["train_tokens"] == total and r["score"] < 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, hits int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of every kind that a stage looks for, with two columns that clash with names of the operators."""
    path = str(tmp_path_factory.mktemp("tables"))
    item = "The quick brown fox of NASA and I jumped over A lazy dog today"
    good = [(i, prose(i, 80 + i)) for i in range(60)]
    near = [(100 + i, prose(i, 80 + i).replace(prose(i, 80 + i).split()[40], "other", 1)) for i in range(10)]
    junk = [(200 + i, " ".join([f"junk{i % 4}"] * 60)) for i in range(30)]
    leaks = [(300, f"I met {prose(70, 30)} {item}! {prose(71, 30)}"), (301, item)]
    private = [(400, f"{prose(80, 30)} a.b@c.de or +1 (555) 555-1234. {prose(81, 9)} token = {'ab12' * 10}")]
    odd = [(None, None), (None, None), (500, ""), (501, None), (502, prose(90, 40)), (502, prose(90, 40))]
    all_ = [*good, *near, *junk, *leaks, *private, *odd]
    data = [(i, t, "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t), "mine", 7) for k, (i, t) in enumerate(all_)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(900, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def groups(texts):
    """Smallest id of the connected documents, by brute force."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    low = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if all(low[low[i]] == low[i] for i in low):
            break
    return low


def test_pipeline(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        seen.append((name, before, after))
        if i < 4:
            assert docs.columns == columns and {(r["score"], r["hits"]) for r in after} == {("mine", 7)}
    stages = {n: (b, a) for n, b, a in seen}
    before, after = stages["quality"]
    left = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {200 + i for i in range(30)} <= left and not left & set(range(60)) and not left & set(range(100, 110))
    weights = quality.train(quality.labelled_rows(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))
    judged = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), weights, ["doc_id"]).collect()
    assert len(after) == sum(r["score"] >= quality.THRESHOLD for r in judged)
    before, after = stages["near_duplicates"]
    low = groups({r["doc_id"]: r["text"] or "" for r in before if r["doc_id"] is not None})
    named = [r["doc_id"] for r in after if r["doc_id"] is not None]
    assert sorted(named) == sorted(i for i in low if low[i] == i) and sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
    before, after = stages["decontaminated"]
    item = "The quick brown fox of NASA and I jumped over A lazy dog today"
    want = {r["doc_id"]: r["text"] and cut_by_hand(r["text"], item, 10) for r in before if r["doc_id"] not in (None, 301)}
    assert {r["doc_id"]: r["text"] for r in after if r["doc_id"] is not None} == want and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in after)
    before, after = stages["redacted"]
    was = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        if r["doc_id"] == 400:
            assert "[EMAIL]" in r["text"] and "[PHONE]" in r["text"] and "a.b@c.de" not in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == was[r["doc_id"]]
    before, after = stages["mixed"]
    assert len(after) == len(before) and all(r["taken"] in {k * r["size"] for k in range(mixing.MOST + 1)} for r in after)
    assert sorted(str(r["text"]) for r in after) == sorted(str(r["text"]) for r in before)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, after))


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_variants_of_one_text(spark):
    """Pairs that are variants of one base text: what stars alone would leave in pieces."""
    from lumenfold.llm import minhash

    rng, base, texts = np.random.default_rng(0), prose(1, 120).split(), {}
    for i in range(120):
        own = list(base)
        for k in rng.choice(120, 7, replace=False):
            own[k] = f"v{i}k{k}"
        other = list(own)
        other[int(rng.integers(120))] = f"w{i}"
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(other)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d).collect()} == groups(texts)


def test_minhash_tasks(spark):
    """Components that merge in later rounds: the tasks stay few where every shuffle has many partitions."""
    from lumenfold.llm import minhash

    rng, base, texts = np.random.default_rng(1), prose(1, 120).split(), {}
    for i in range(40):
        own = list(base)
        for k in rng.choice(120, 7, replace=False):
            own[k] = f"v{i}k{k}"
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join([*own[:60], f"w{i}", *own[61:]])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    state = spark.sparkContext._jsc.sc()

    def tasks():
        state.listenerBus().waitUntilEmpty()
        return state.statusStore().executorSummary("driver").totalTasks()

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        start = tasks()
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d).collect()}
        assert tasks() - start < 1700  # 2298 once, 1212 now
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == groups(texts)


def test_components(spark, monkeypatch):
    """Chains, circles, stars around large ids, repeated edges and loops, with broadcasts and without."""
    from lumenfold.llm import _shared

    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)] + [(999, i) for i in range(300, 340)] + [(7, 7), (5, 6), (6, 5), (5, 6)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (110, 2))]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    d = spark.createDataFrame(edges, "a long, b long")
    for few in (_shared.TASK_ROWS, 0):
        monkeypatch.setattr(_shared, "TASK_ROWS", few)
        got = _shared.connected_components(d).collect()
        assert len(got) == len(root) and {r["node"]: r["root"] for r in got} == root
    assert _shared.connected_components(d.where("a = b")).count() == 0


def test_odd_bytes_and_ids(spark):
    from lumenfold.llm import langid, licenses, lm_score

    bad = F.unhex(F.lit("61FF62C3")).cast("string")
    d = spark.createDataFrame([((1 << 60) + 1, "one two"), (None, "x"), ((1 << 60) + 3, "two")], "doc_id long, text string").unionByName(spark.range(1).select(F.lit(7).cast("long").alias("doc_id"), bad.alias("text")))
    got = lm_score.score_documents(d.withColumn("train", F.lit(True))).collect()
    assert {r["doc_id"] for r in got} == {(1 << 60) + 1, (1 << 60) + 3, None, 7}
    assert licenses.scan_licenses(d).count() == langid.identify(d, {"en": b"one two"}).count() == pii.find_pii(d).count() == 4
