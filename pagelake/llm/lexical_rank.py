"""Ranked lexical search for a table of items, by bags of the items' words.

Items are taken in blocks of about BLOCK_TERMS words, told to every task. Documents are restricted to a block's words:
a bag is the words' numbers and frequencies, and m, what length adds to a frequency. Documents with equal bags are a
class: they meet by a hash, and the bags behind it are compared. A class is scored once against the block's items, as
products of its words' worths with the matrix of which item has which word, in numbers that doubles hold exactly. A class
carries its MOST smallest ids: among equal scores ids ascend, so no other member can be among an item's first MOST. The
best MOST classes of a task, by score and smallest id, have all that is needed of it for the same reason.

Null and empty texts have no words. Rows that repeat a doc_id are documents of their own; a null doc_id comes last among
equal scores. Items without words, or whose words no document has, give no row; rows that repeat an item_id are items of
their own. A very long text is one unit of work, in memory in proportion to it; so is a very long item. An empty table of
either kind gives no rows. Other columns than doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Documents returned for an item; words of the items of a block, about (told to tasks: some 100 bytes each).
MOST, BLOCK_TERMS = 10, 1_000_000
#: Cells of the dense parts in which classes are scored (8 bytes each).
CELLS = 1 << 21

#: Every byte as itself, A-Z as a-z, and as a blank what no word holds: ASCII that is neither letter nor digit.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _bags(vocabulary):
    """For mapInArrow over (doc_id, text): (doc_id, n, terms, tfs) of documents with a word, terms ascending."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = vocabulary.value
        for batch in batches:
            at, n, ends, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                if words:
                    bag = sorted((number_of[w], c) for w, c in Counter(words).items() if w in number_of)
                    at.append(i)
                    n.append(len(words))
                    terms += [t for t, _ in bag]
                    tfs += [c for _, c in bag]
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return made


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): of each document with a word the number of words, and which of the vocabulary it has how often; written."""
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(vocabulary)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>"
    return written(docs.select("doc_id", "text").mapInArrow(_bags(told), schema))


def classes(found: DataFrame, docs: int, words: int, most: int = MOST) -> DataFrame:
    """(m, terms, tfs, ids): distinct bags with the `most` smallest doc_ids of each. `docs`, `words`: those of the whole table."""
    m = F.expr(f"cast(10 + (cast(90 AS decimal(38, 0)) * n * {docs}) div {words} AS bigint)")
    keyed = found.where("size(terms) > 0").select("doc_id", m.alias("m"), "terms", "tfs").withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    # The hash deals out and sorts; the bag beside it tells bags of equal hash apart. Each task sends `most` of a class at most.
    members = Window.partitionBy("hash", "m", "terms", "tfs").orderBy(F.col("doc_id").asc_nulls_last())
    first = keyed.withColumn("r", F.row_number().over(members)).where(F.col("r") <= most)
    return first.groupBy("hash", "m", "terms", "tfs").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))).alias("ids")).drop("hash")


def _scored(told, most: int):
    """For mapInArrow over classes: each item's `most` best classes of the task, as (item, score, ids)."""

    def points(m, sizes, terms, tfs, part) -> np.ndarray:
        """Scores of classes (rows) by a slice's items (columns)."""
        weights, starts, holders, n, _ = part
        tf, row = tfs.astype(np.int64), np.repeat(np.arange(len(m)), sizes)
        worth = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        held = starts[terms + 1] - starts[terms]
        at = np.repeat(np.arange(len(terms)), held)
        item = holders[np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held) + starts[terms][at]]
        return np.bincount(row[at] * n + item, weights=worth[at].astype(np.float64), minlength=len(m) * n).reshape(len(m), n)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = told.value
        best: dict[int, list] = {}
        least = [np.zeros(part[3]) for part in slices]  # the worst score that an item's full list holds
        for batch in batches:
            m, ids = batch.column("m").to_numpy(), batch.column("ids")
            ends = batch.column("terms").offsets.to_numpy()
            terms, tfs = batch.column("terms").values.to_numpy(), batch.column("tfs").values.to_numpy()
            for s, part in enumerate(slices):
                expanded = np.concatenate(([0], np.cumsum((part[1][1:] - part[1][:-1])[terms])))[ends]
                a = 0
                while a < len(m):
                    b = int(np.searchsorted(expanded, expanded[a] + CELLS, side="right")) - 1
                    b = max(a + 1, min(b, len(m), a + max(1, CELLS // part[3])))
                    found = points(m[a:b], np.diff(ends[a : b + 1]), terms[ends[a] : ends[b]], tfs[ends[a] : ends[b]], part)
                    bar = np.maximum(least[s], np.partition(found, len(found) - most, axis=0)[len(found) - most] if len(found) > most else 0)
                    for item in np.flatnonzero(((found >= bar) & (found > 0)).any(axis=0)).tolist():
                        own = best.setdefault((s, item), [])
                        for k in np.flatnonzero((found[:, item] >= bar[item]) & (found[:, item] > 0)).tolist():
                            members = [(d["none"], d["doc_id"]) for d in ids[a + k].as_py()]
                            own.append((-int(found[k, item]), members))
                        own.sort()
                        del own[most:]
                        if len(own) == most:
                            least[s][item] = -own[-1][0]
                    a = b
        rows = [{"item": slices[s][4] + item, "score": -score, "ids": [d for _, d in members]} for (s, item), own in best.items() for score, members in own]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.int64()), ("score", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return made


def _slices(items: list[list[int]], weights: np.ndarray, n: int) -> list[tuple]:
    """(weights, starts, holders, number of items, first item) for each `n` items: which items have a word."""
    out = []
    for first in range(0, len(items), n):
        own = items[first : first + n]
        term = np.concatenate([np.array(t, dtype=np.int64) for t in own])
        item = np.repeat(np.arange(len(own)), [len(t) for t in own])
        starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(weights)))))
        out.append((weights, starts, item[np.argsort(term, kind="stable")], len(own), first))
    return out


def ranked(docs: DataFrame, items: DataFrame, most: int = MOST, block_terms: int = BLOCK_TERMS, slice_items: int = 4_096) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` best documents of each item, those of score 0 left out."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = items.schema["item_id"].dataType.simpleString()
    told = items.select("item_id", "text").mapInArrow(_item_words, f"item_id {id_type}, words array<binary>")
    told = written(told.where("size(words) > 0").withColumn("at", F.monotonically_increasing_id()))
    blocks = max(1, -(-(told.agg(F.sum(F.size("words"))).first()[0] or 0) // block_terms))
    results = []
    for block in range(blocks):
        own = told.where(F.col("at") % blocks == block).select("item_id", "words").collect()  # block_terms words, about
        vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in own for w in r["words"]}))}
        found = bags(docs, vocabulary)
        n, words = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's words at most
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], dtype=np.int64)
        parts = _slices([[vocabulary[bytes(w)] for w in r["words"]] for r in own], weights, slice_items) if n and own else []
        if not parts:
            continue
        scored = classes(found, n, words, most).mapInArrow(_scored(spark.sparkContext.broadcast(parts), most), "item long, score long, ids array<long>")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = scored.select("item", "score", F.explode("ids").alias("doc_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item long, item_id {id_type}")
        results.append(written(best.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    if not results:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words): the distinct words of items."""
    for batch in batches:
        words = [sorted(set(words_of(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.binary()))], ["item_id", "words"])


def op12(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
f AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY doc_id, n, term),
v AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, totals GROUP BY term, docs),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS points FROM f JOIN v USING (term), totals),
s AS (SELECT item_id, doc_id, CAST(sum(points) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10
"""
