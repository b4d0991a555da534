"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard, merged over shards.

Equal vectors are one class, of which the smallest ids suffice for any answer; they are told by a digest. Classes are
dealt over shards by hash; a shard's graph is built in one task and written as flat arrays: for each level the nodes of
it and, in one matrix, their neighbours. Nodes go in by rounds that double; a round's nodes look for their neighbours in
the graph of the rounds before, all at once, so that building and searching are matrix work. Queries are packed in
blocks. A task takes a shard's graph once and the blocks of queries one after another, as they stream by; blocks go to
every shard, a shard goes out once for each QUERIES_A_TASK queries. Each shard's best are merged by a window per query.

The score is the cosine in double precision on the original vectors, however large or small their components. Vectors that are null, empty, zero or hold a null
or non-finite component take no part; vectors of another length are never compared. Ties go to the smaller id. Equal
ids are rows like any other, but none is a neighbour of its own id; fewer than k other vectors give what there is. A
very long vector makes its shard larger in proportion. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a shard, about. A larger shard means fewer graphs for a query to visit and more memory to build one.
SHARD_ROWS = 4_096
#: Queries in a block, and queries that one task looks up in a shard, about.
BLOCK, QUERIES_A_TASK = 512, 65_536
#: Neighbours of a node above the ground level; twice that on it. Candidates kept in building and in searching.
LINKS, BUILD, SEARCH = 16, 64, 96


#: Vectors whose greatest component lies beyond 2**200 or below 2**-200, moved near 1 by a power of two, in two steps as one
#: may be too large: squares then neither overflow nor vanish, and the cosine stays what it is.
NEAR_ONE = """transform(array(named_struct('v', v, 'e', cast(floor(log2(array_max(transform(v, x -> abs(x))))) AS int))),
  s -> if(abs(s.e) <= 200, s.v, transform(s.v, x -> x * pow(2D, -(s.e div 2)) * pow(2D, (s.e div 2) - s.e))))[0]"""


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query at once: the `width` best nodes met by best-first search from `entry`, and their cosines; -1 where fewer."""
    n, q = len(vectors), len(queries)
    rows = np.arange(q)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # where no neighbour is, that is node n
    nodes = np.full((q, width), -1, dtype=np.int32)
    scores = np.full((q, width), -np.inf, dtype=np.float32)
    done = np.ones((q, width), dtype=bool)
    nodes[:, 0], scores[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", vectors[entry], queries), False
    seen[rows, entry] = True
    while len(active := np.flatnonzero(~done.all(axis=1))):
        open_scores = np.where(done[active], -np.inf, scores[active])
        pick = open_scores.argmax(axis=1)
        done[active, pick] = True
        near = links[nodes[active, pick]]
        at = np.where(near < 0, n, near)
        fresh = ~seen[active[:, None], at]
        seen[active[:, None], at] = True
        found = np.where(fresh, np.einsum("qmd,qd->qm", vectors[np.maximum(near, 0)], queries[active]), -np.inf).astype(np.float32)
        all_scores = np.concatenate((scores[active], found), axis=1)
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        pool = np.concatenate((nodes[active], np.where(fresh, near, -1)), axis=1)
        finished = np.concatenate((done[active], ~fresh), axis=1)
        nodes[active] = np.take_along_axis(pool, best, axis=1)
        scores[active] = np.take_along_axis(all_scores, best, axis=1)
        done[active] = np.take_along_axis(finished, best, axis=1)
    return nodes, scores


def _diverse(vectors: np.ndarray, nodes: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first: those nearer to the row than to one already chosen, then others to fill up."""
    order = np.argsort(-scores, axis=1, kind="stable")
    nodes, scores = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(scores, order, axis=1)
    q, c = nodes.shape
    among = np.einsum("qid,qjd->qij", vectors[np.maximum(nodes, 0)], vectors[np.maximum(nodes, 0)])
    chosen = np.zeros((q, c), dtype=bool)
    for i in range(c):
        blocked = (np.where(chosen, among[:, i], -np.inf) > scores[:, i : i + 1]).any(axis=1)
        chosen[:, i] = (nodes[:, i] >= 0) & ~blocked & (chosen.sum(axis=1) < most)
    rank = np.argsort(~chosen * 2 + (nodes < 0), axis=1, kind="stable")[:, :most]
    return np.pad(np.take_along_axis(nodes, rank, axis=1), ((0, 0), (0, max(0, most - c))), constant_values=-1)


class Graph:
    """Flat neighbour arrays: links[level] is a matrix over all nodes, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.links, self.entry = vectors, links, entry

    def enter(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        at = np.full(len(queries), self.entry)
        for level in range(len(self.links) - 1, down_to, -1):
            at = _beam(self.vectors, self.links[level], queries, at, 1)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return _beam(self.vectors, self.links[0], queries, self.enter(queries, 0), width)

    @classmethod
    def built(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        n = len(vectors)
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
        levels[0] = max(levels.max(), 0)
        graph = cls(vectors, [np.full((n, LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(levels[0] + 1)], 0)
        start, step = 1, 1
        while start < n:
            stop = min(n, start + step)
            fresh = [(level, np.flatnonzero(levels[start:stop] >= level) + start) for level in range(levels[0], -1, -1)]
            # All levels are searched before any is linked: a node already linked above would be its own way in below.
            near = [(level, new, graph._near(level, new, start)) for level, new in fresh if len(new)]
            for level, new, found in near:
                graph._link(level, new, *found)
            start, step = stop, min(stop, 512)
        return graph

    def _near(self, level: int, new: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        return _beam(self.vectors, self.links[level], self.vectors[new], self.enter(self.vectors[new], level), min(BUILD, before))

    def _link(self, level: int, new: np.ndarray, nodes: np.ndarray, scores: np.ndarray) -> None:
        # Nodes of the same round see each other too.
        mates = self.vectors[new] @ self.vectors[new].T
        np.fill_diagonal(mates, -np.inf)
        k = min(LINKS, len(new) - 1)
        if k:
            near = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            nodes = np.concatenate((nodes, new[near].astype(np.int32)), axis=1)
            scores = np.concatenate((scores, np.take_along_axis(mates, near, axis=1)), axis=1)
        most = self.links[level].shape[1]
        self.links[level][new] = _diverse(self.vectors, nodes, scores, LINKS if level else LINKS + LINKS // 2)[:, :most] if level else np.pad(_diverse(self.vectors, nodes, scores, LINKS + LINKS // 2), ((0, 0), (0, most - LINKS - LINKS // 2)), constant_values=-1)
        # The other way round: each neighbour gets the new node, and chooses anew where it has too many.
        pairs = np.stack((self.links[level][new].ravel(), np.repeat(new, most)), axis=1)
        pairs = pairs[pairs[:, 0] >= 0]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        targets, first, counts = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        for count in np.unique(counts):
            rows = targets[counts == count]
            added = pairs[first[counts == count][:, None] + np.arange(count), 1]
            have = self.links[level][rows]
            pool = np.concatenate((have, np.where((added[:, :, None] == have[:, None, :]).any(axis=2), -1, added)), axis=1).astype(np.int32)
            full = (pool >= 0).sum(axis=1) > most
            packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), axis=1)
            self.links[level][rows[~full]] = packed[~full][:, :most]
            if full.any():
                score = np.where(pool[full] >= 0, np.einsum("rcd,rd->rc", self.vectors[np.maximum(pool[full], 0)], self.vectors[rows[full]]), -np.inf)
                self.links[level][rows[full]] = _diverse(self.vectors, pool[full], score, most)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("class_id", kind="stable")
    graph = Graph.built(_unit(np.array(rows["v"].tolist())))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "dims": [len(rows["v"].iloc[0])], "ids": [rows["class_id"].to_numpy().tobytes()], "vectors": [np.array(rows["v"].tolist()).tobytes()],
                         "links": [[x.tobytes() for x in graph.links]], "entry": [graph.entry]})


def _search(k: int):
    """For mapInPandas over rows sorted by shard and part, the shard's own row first, then blocks of queries, whose
    `ids` are null: the k + 1 best of each query in it."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, graph, ids, vectors, lengths = None, None, None, None, None
        for batch in batches:
            for row in batch.itertuples():
                if row.ids is not None:
                    key, ids, vectors = (row.shard, row.part), np.frombuffer(row.ids, np.int64), np.frombuffer(row.vectors, np.float64).reshape(-1, int(row.dims))
                    graph = Graph(_unit(vectors), [np.frombuffer(x, np.int32).reshape(len(ids), -1) for x in row.links], int(row.entry))
                    lengths = (vectors * vectors).sum(axis=1)
                elif key == (row.shard, row.part):
                    queries, asked = np.array(row.queries, dtype=np.int64), np.frombuffer(row.asked, np.float64).reshape(-1, int(row.dims))
                    nodes, _ = graph.search(_unit(asked), SEARCH)
                    # Exact cosines of all that the search has kept, on the original vectors.
                    a, b = asked[:, None, :], vectors[np.maximum(nodes, 0)]
                    score = np.where(nodes >= 0, (a * b).sum(axis=2) / np.sqrt((a * a).sum(axis=2) * lengths[np.maximum(nodes, 0)]), -np.inf)
                    order = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                    node, score = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)
                    keep = node >= 0
                    yield pd.DataFrame({"query_class": np.repeat(queries, keep.sum(axis=1)), "class_id": ids[node[keep]], "score": score[keep]})

    return made


def nearest(embeddings: DataFrame, every: int, k: int = 5, shard_rows: int = SHARD_ROWS, queries_a_task: int = QUERIES_A_TASK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`, among all other rows."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(whole)
    rows = rows.withColumn("v", F.expr(NEAR_ONE))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256)))
    classes = written(rows.groupBy("digest").agg(F.min("vec_id").alias("class_id"), F.first("v").alias("v")))
    members = written(rows.select("vec_id", "digest").join(classes.select("digest", "class_id"), "digest").select("vec_id", "class_id"))
    # k + 1 ids of a class answer any query; found within salted parts first, as a class may be large.
    salted = Window.partitionBy("class_id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    among = Window.partitionBy("class_id").orderBy("vec_id")
    first = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(among)).where(F.col("r") <= k + 1)
    first = written(first.groupBy("class_id").agg(F.collect_list("vec_id").alias("ids")))
    asked = written(members.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query_class")))

    shards = max(1, round(classes.count() / shard_rows))
    dealt = classes.select("class_id", "v", F.concat_ws("-", F.size("v"), F.pmod(F.xxhash64("class_id"), F.lit(shards))).alias("shard"))
    index = written(dealt.groupBy("shard").applyInPandas(_index, "shard string, dims int, ids binary, vectors binary, links array<binary>, entry int"))

    queries = asked.count()
    blocks, parts = max(1, -(-queries // BLOCK)), max(1, -(-queries // queries_a_task))
    wanted = asked.select("query_class").distinct().join(classes, F.col("query_class") == F.col("class_id")).select("query_class", "v")
    pack = lambda r: pd.DataFrame({"dims": [len(r["v"].iloc[0])], "queries": [r["query_class"].to_numpy()], "asked": [np.array(r["v"].tolist()).tobytes()]})
    packed = wanted.withColumn("size", F.size("v")).withColumn("block", F.pmod(F.xxhash64("query_class"), F.lit(blocks))).groupBy("size", "block").applyInPandas(pack, "dims int, queries array<long>, asked binary")
    part = F.pmod(F.xxhash64(F.col("queries")[0]), F.lit(parts)).cast("int")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ids", "binary"), ("vectors", "binary"), ("links", "array<binary>"), ("entry", "int"))]
    blocks_of = written(packed).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(F.concat_ws("-", "dims", "s").alias("shard"), part.alias("part"), "dims", *none, "queries", "asked")
    shards_of = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dims", "ids", "vectors", "links", "entry", F.lit(None).cast("array<long>").alias("queries"), F.lit(None).cast("binary").alias("asked"))
    met = shards_of.union(blocks_of).repartition(max(12, min(shards * parts, 4_000)), "shard", "part").sortWithinPartitions("shard", "part", F.col("ids").isNull())
    found = met.mapInPandas(_search(k), "query_class long, class_id long, score double")
    best = Window.partitionBy("query_class").orderBy(F.col("score").desc(), "class_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    answers = asked.join(found, "query_class").join(first, "class_id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50)
