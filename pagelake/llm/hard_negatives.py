"""Hard negatives for contrastive training, by a secondary sort of pair scores.

Components become floor(256 * x), so a score is an integer inner product and ties are exact. Rows are packed as they come
into groups, anchors into blocks; every block meets every group, as matrix products. First the groups' best pairs of equal
labels give each anchor its positives. Then each group sends those pairs of unequal labels that can be among the first
`most` of one of the anchor's windows: it knows the windows, so what it leaves out has `most` better pairs of the same
group before it in each. Positives and negatives are packed into keys (anchor, descending score, positives first, id);
repartitionAndSortWithinPartitions brings each anchor's pairs into that order, and an iterator reads them once: a positive
opens its window, a negative goes out for each window that is open for it. It holds an anchor's windows, never its pairs.

Rows take no part whose id or label or vector is null, or whose vector holds a null or non-finite component. Vectors meet
those of their own length; empty ones have the score 0. Floors are held within sqrt(2**59 / length), so that ten times a
sum fits 64 bits (for 64 components: |x| up to some 370,000). Repeated ids are rows of their own, but none is an anchor's
partner under the anchor's own id; rows that repeat an anchor give its triples again. A positive below 0 has no window, one
of score 0 that of score 0. A very long vector is one unit of work. An empty table gives no rows; no other columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components in a group of rows, about (16 MB); rows that Spark deals into one group at most; anchors in a block.
CELLS, GROUP_ROWS, BLOCK = 1 << 22, 65_536, 64
#: Units of work (a group and its share of blocks) below which groups are sent to more tasks.
UNITS = 8
#: A window in tenths of its positive's score.
LOW, HIGH = 3, 9

_KEY, _BYTES = ">QQBQ", 25
_KEYS = np.dtype([("anchor", ">u8"), ("falling", ">u8"), ("kind", "u1"), ("id", ">u8")])
_TOP, _MIDDLE = 1 << 62, 1 << 63

_PACKED = "key long, dims int, ids binary, labels binary, vectors binary"


def _packing(cells: int, rows: int):
    """For mapInArrow over (vec_id, label, v): groups of rows by ascending id, as binary columns. `rows` bounds a group."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = TaskContext.get().partitionId() << 32, {}

        def group(dims: int, parts: list) -> pa.RecordBatch:
            nonlocal key
            ids, labels, vectors = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(ids, kind="stable")
            key += 1 << 16
            return pa.RecordBatch.from_pylist([{"key": key, "dims": dims, "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": vectors[order].tobytes()}], schema=packed)

        packed = pa.schema([("key", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
        for batch in batches:
            ids, labels, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("v")
            ends = v.offsets.to_numpy()
            flat, sizes, starts = v.values.to_numpy(), np.diff(ends), ends[:-1]
            for dims in np.unique(sizes).tolist():
                limit = int((2**59 / max(dims, 1)) ** 0.5)
                at = np.flatnonzero(sizes == dims)
                most = min(rows, max(1, cells // max(dims, 1)))
                for k in range(0, len(at), most):
                    own = at[k : k + most]
                    x = np.floor(256 * flat[starts[own][:, None] + np.arange(dims)])
                    waiting.setdefault(dims, []).append((ids[own], labels[own], np.clip(x, -limit, limit).astype(np.int32)))
                    if sum(len(p[0]) for p in waiting[dims]) >= most:
                        yield group(dims, waiting.pop(dims))
        for dims, parts in waiting.items():
            yield group(dims, parts)

    return made


def _first(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of ascending `rows`, those with the k greatest scores; of equal ones the first."""
    if len(rows) <= k:
        return rows
    own = scores[rows]
    least = np.partition(own, len(own) - k)[len(own) - k]
    above = rows[own > least]
    return np.concatenate((above, rows[own == least][: k - len(above)]))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if size < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _keys(anchor: int, scores: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    out = np.empty(len(ids), dtype=_KEYS)
    out["anchor"], out["falling"], out["kind"] = anchor, (_TOP - scores).astype(np.uint64), kind
    out["id"] = ids.astype(np.uint64) + np.uint64(_MIDDLE)  # signed order as unsigned, by wrapping
    raw = out.tobytes()
    return [raw[i : i + _BYTES] for i in range(0, len(raw), _BYTES)]


def _meeting(positives: int, most: int, searching: bool):
    """For mapInPandas over rows sorted by group and part, the group's own row first, then blocks of anchors: the keys of
    each anchor's best pairs of its label, or of the pairs that its windows may need."""

    def rows_of(row):
        ids = np.frombuffer(row.ids, np.int64)
        return ids, np.frombuffer(row.labels, np.int64), np.frombuffer(row.vectors, np.int32).reshape(len(ids), int(row.dims))

    def pairs(row, ids, labels, vectors) -> Iterator[tuple[int, bytes]]:
        own_ids, own_labels, own = rows_of(row)
        for i in range(0, len(own_ids), 16):
            for j, scores in enumerate(_products(own[i : i + 16], vectors), i):
                others = ids != own_ids[j]
                if searching:
                    found = [_first(scores, np.flatnonzero(others & (labels == own_labels[j])), positives)]
                else:
                    others &= labels != own_labels[j]
                    windows = {(-(-LOW * int(score) // 10), HIGH * int(score) // 10) for slot, score in row.windows if slot == j}
                    found = [_first(scores, np.flatnonzero(others & (scores >= low) & (scores <= high)), most) for low, high in windows]
                best = np.unique(np.concatenate(found)) if found else np.zeros(0, int)
                for key in _keys(int(row.block) + j, scores[best], int(not searching), ids[best]):
                    yield int(own_ids[j]), key

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held = None, None
        for batch in batches:
            for row in batch.itertuples():
                if pd.isna(row.block):
                    unit, held, dims = (row.group, row.part), rows_of(row), row.dims
                elif unit == (row.group, row.part) and dims == row.dims:
                    found = list(pairs(row, *held))
                    if found:
                        yield pd.DataFrame(found, columns=["anchor_id", "key"])

    return made


def _triples(most: int):
    """For mapPartitions over (key, anchor_id) in the order of the keys."""

    def made(pairs: Iterable[tuple[bytes, int]]) -> Iterator[tuple]:
        current, windows = None, []
        for key, anchor_id in pairs:
            anchor, falling, kind, number = struct.unpack(_KEY, key)
            score, vec_id = _TOP - falling, number - _MIDDLE
            if anchor != current:
                current, windows = anchor, []
            if kind == 0:
                windows.append([vec_id, score, 0])
                continue
            for window in windows:
                positive_id, positive, sent = window
                if sent < most and LOW * positive <= 10 * score <= HIGH * positive:
                    window[2] += 1
                    yield anchor_id, positive_id, sent + 1, vec_id, positive, score

    return made


def mined(rows: DataFrame, every: int = 100, positives: int = 5, most: int = 10, group_rows: int = GROUP_ROWS, units: int = UNITS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    Anchors are rows whose vec_id is divisible by `every`.
    """
    spark = rows.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    taken = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    taken = written(taken.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(whole))
    asked = taken.where(F.col("vec_id") % every == 0)
    n, anchors = taken.count(), asked.count()
    groups = max(1, -(-n // group_rows))
    # Dealt without a key: equal ids or vectors don't weigh on a group.
    packed = written(taken.repartition(groups).mapInArrow(_packing(CELLS, group_rows), _PACKED))
    blocks = written(asked.repartition(max(1, -(-anchors // 8_192))).mapInArrow(_packing(CELLS, BLOCK), _PACKED))
    parts = max(1, min(-(-anchors // BLOCK), units // groups))

    # Each length's groups: a number for GROUP_ROWS rows.
    own = written(packed.groupBy("dims").agg(F.collect_list("key").alias("groups")))

    def met(blocks: DataFrame, windows: Column, searching: bool) -> DataFrame:
        none = F.lit(None).cast("long").alias("block"), F.lit(None).cast("array<array<long>>").alias("windows")
        held = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.col("key").alias("group"), "part", "dims", "ids", "labels", "vectors", *none)
        part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
        asked = blocks.join(own, "dims").select(F.explode("groups").alias("group"), part, "dims", "ids", "labels", "vectors", F.col("key").alias("block"), windows.alias("windows"))
        dealt = held.union(asked).repartition(max(12, min(groups * parts, 4_000)), "group", "part").sortWithinPartitions("group", "part", F.col("block").isNotNull())
        return dealt.mapInPandas(_meeting(positives, most, searching), "anchor_id long, key binary")

    # A key's bytes stand for (anchor, descending score, kind, id), so the least keys are the best pairs.
    anchor = F.substring("key", 1, 8)
    best = Window.partitionBy(anchor).orderBy("key")
    chosen = met(blocks, F.lit(None).cast("array<array<long>>"), True).withColumn("r", F.row_number().over(best))
    chosen = written(chosen.where(F.col("r") <= positives).drop("r"))
    number = lambda start: F.conv(F.hex(F.substring("key", start, 8)), 16, 10).cast("long")
    opened = chosen.select(number(1).alias("a"), (F.lit(_TOP) - number(9)).alias("score"))
    opened = opened.groupBy(F.expr("a - a % 65536").alias("key")).agg(F.collect_list(F.array(F.expr("a % 65536"), "score")).alias("w"))
    found = met(blocks.join(opened, "key"), F.col("w"), False)
    pairs = chosen.union(found).rdd.map(lambda r: (bytes(r["key"]), r["anchor_id"]))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:8]))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(ordered.mapPartitions(_triples(most)), schema, verifySchema=False)


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return mined(rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS s
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM p WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5),
neg AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, s AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS r
  FROM pos JOIN p USING (anchor_id)
  WHERE label <> own AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE r <= 10
"""
