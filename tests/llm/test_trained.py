"""Operators that learn or approximate: held-out accuracy, recall, and what must hold for any model."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelake.llm import hnsw, licences, quality, toxicity

SF = "/root/testdata/sf0.01"


def area(score, label):
    good, bad = score[label == 1], score[label == 0]
    return (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()


def test_neighbours(spark):
    found = hnsw.op1(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v, ids = np.array(rows["embedding"].tolist(), dtype=float), rows["vec_id"].to_numpy()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, part in found.groupby("query_id"):
        cosine = unit @ unit[ids == q][0]
        order = [i for i in np.lexsort((ids, -cosine)) if ids[i] != q][:5]
        hits += len(set(ids[order]) & set(part["vec_id"]))
        assert part.sort_values("rank")["score"].is_monotonic_decreasing
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (50, [2.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(e, 50).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 1.0), (50, 4, 3, 0.0)]
    assert hnsw.nearest(e.where("false"), 50).count() == 0
    wide = e.withColumn("score", F.lit(1)).withColumn("shard", F.lit("x")).unionByName(e.limit(1).withColumn("score", F.lit(2)).withColumn("shard", F.lit("y")))
    again = hnsw.nearest(wide, 50, shard_rows=2, queries_a_task=1).where("query_id = 50")
    assert [(r["rank"], r["vec_id"]) for r in again.orderBy("rank").collect()] == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]


@pytest.mark.parametrize("op,column,least", [(quality.op6, "quality", 0.9), (toxicity.op9, "toxic", 0.8)])
def test_held_out(spark, op, column, least):
    rows = op(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = rows.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert area(held["score"].to_numpy(), held[column].to_numpy()) >= least
    assert rows.where("NOT score BETWEEN 0 AND 1").count() == 0


def test_models_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "\n\n", "x"), (4, "word " * 30_000, "x"), (4, "i d i o t", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for empty in (labels, labels.where("false")):
        assert toxicity.scored(docs, toxicity.train(docs, empty)).count() == 5
        assert quality.scored(docs, quality.train(docs, empty)).count() == 5
    assert toxicity.clean(docs, labels).columns == docs.columns and toxicity.clean(docs, labels).count() == 5
    trained = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert quality.scored(docs, trained).where("score IS NULL").count() == 0
    assert quality.scored(docs.where("false"), trained).count() == 0


def test_quality_trains_on_bounded_stretches(spark):
    """A document of very many lines gives the fit no more than TRAIN_LINES; of two labels the greater holds, in any order."""
    long = "\n".join(f"line {i} of a long table" for i in range(100_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([7, 8], pa.int64()), "text": [long, "one\ntwo"], "label": pa.array([1, 0], pa.int32())})
    made = next(quality._featured(iter([batch]))).to_pydict()
    assert [len(w) // 4 for w in made["w"]] == [quality.TRAIN_LINES, 2]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-7, long), (-8, None)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    twice = labels.unionByName(labels.selectExpr("doc_id", "0 AS quality")).unionByName(spark.createDataFrame([(-7, 1)], "doc_id long, quality int"))
    one, other = quality.train(docs, twice), quality.train(docs.repartition(3), twice.orderBy("quality"))
    assert np.array_equal(one.weights, other.weights) and one.weights.any()
    found = {r["doc_id"]: r["score"] for r in quality.scored(docs.where("doc_id < 0"), one).collect()}
    assert set(found) == {-7, -8} and all(0 <= s <= 1 for s in found.values())


def test_kernel_is_that_of_enumeration():
    """Normalised weights of common subsequences, place by place."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcé"), n)).encode() for n in rng.integers(3, 10, 60)]

    def subsequences(w):
        out = {}
        for p in itertools.combinations(range(len(w)), toxicity.ORDER):
            key = bytes(w[i] for i in p)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (p[-1] - p[0] + 1)
        return out

    inner = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items())
    letters = [toxicity._letters(w) for w in words]
    marks = [w for w in letters if len(w) > toxicity.ORDER][:10]
    found = toxicity.Landmarks(marks).of(words)
    for w, row in zip(letters, found):
        for m, k in zip(marks, row):
            a, b = subsequences(w), subsequences(m)
            exact = inner(a, b) / np.sqrt(inner(a, a) * inner(b, b)) if a else 0
            common = len(set(toxicity._BIT[list(w)]) & set(toxicity._BIT[list(m)]))
            enough = common >= max(2, np.ceil(0.75 * len(set(toxicity._BIT[list(m)]))))
            assert k == pytest.approx(exact if exact >= toxicity.FLOOR and enough else 0, abs=1e-5)


def test_kernel_tolerates_insertions():
    marks = toxicity.Landmarks([b"idiot", b"worthless"])
    near = marks.of([b"idiot", b"id1iot", b"idxiot", b"worthlessly", b"table"])
    assert near[0, 0] > 0.99 and near[1, 0] > 0.7 and near[2, 0] > 0.5 and near[3, 1] > 0.8 and near[4].max() == 0


def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(3)
    score, transitions = rng.normal(size=4), rng.normal(size=(2, 2))
    weight = np.zeros((4, 2))
    for bits in range(16):
        y = [bits >> i & 1 for i in range(4)]
        w = np.exp(sum(s for s, b in zip(score, y) if b) + sum(transitions[a, b] for a, b in zip(y, y[1:])))
        for i, b in enumerate(y):
            weight[i, b] += w
    found, _ = quality.marginals(score, transitions, np.zeros(4, int))
    assert np.allclose(found, weight[:, 1] / weight.sum(axis=1))


def test_licences(spark):
    """Whatever notices the documents hold, told by a string that only their families have."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    named = {"Apache License": "apache", "MIT License": "mit", "GNU General": "gpl", "CC BY-NC": "cc-by-nc", "All rights reserved": "proprietary"}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: set(r["families"]) for r in licences.scan(docs).collect()}
    assert found == {d: {f for mark, f in named.items() if mark in t} for d, t in texts.items()}


def test_licences_wrapped_and_odd(spark):
    prose = "The harbour was quiet, and the boats lay at anchor\nuntil the evening came. Nobody spoke.\n"
    wrapped = "\n".join(["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU Affero General Public License as", "published by the Free Software Foundation."])
    texts = [prose + wrapped, prose + "\n" + wrapped + "\n\n" + prose, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files, to deal in the\nSoftware without restriction", None, "", "\n\n", prose * 2_000 + "Released under the MIT License.", prose, prose]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)], "doc_id long, text string, families string, p double")
    found = {r["doc_id"]: r["families"] for r in licences.scan(docs).collect()}
    assert found == {0: ["agpl"], 1: ["agpl"], 2: ["mit"], 3: [], 4: [], 5: [], 6: ["mit"], 7: [], 8: []}
    assert licences.scan(docs.where("false")).count() == 0
    again = licences.scan(docs.unionByName(docs))
    assert again.count() == 18 and again.where("size(families) > 0").count() == 8


@pytest.mark.parametrize("shard_rows", [500, 4_096])
def test_recall_over_shards(spark, shard_rows):
    """Neighbours found in four shards or one, against all of them; none twice."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {}
    for r in hnsw.nearest(e, 50, shard_rows=shard_rows).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        hits += len(found[ids[q]] & set(ids[np.argsort(-score, kind="stable")[:5]].tolist()))
    assert all(len(f) == 5 for f in found.values()) and hits >= 0.98 * 5 * len(found)


def test_graph_reaches_every_node():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 600):
        unit = hnsw._unit(rng.normal(size=(n, 8)))
        graph = hnsw.Graph.built(unit)
        assert all(not (x == np.arange(n)[:, None]).any() for x in graph.links)
        nodes = graph.search(unit[:1], 2 * n)[0][0]
        assert sorted(nodes[nodes >= 0].tolist()) == list(range(n))
