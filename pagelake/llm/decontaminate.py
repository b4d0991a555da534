"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, looked up by every training window.

Words are taken byte-exactly (`ALNUM_WORD`, A-Z lower-cased). A window of the test set is `n` consecutive item words,
or all words of an item that has fewer. Each document makes its windows as text, so the hash join verifies a hit by
comparing the words themselves; only hits and one marker row a document leave the scan, pre-aggregated.

Null or empty texts have no words and no hits. Items without words have no window. Repeated items, repeated windows
and ties count as they stand: `n_items` counts item ids. Rows that repeat a doc_id and its number of words give one row
with the hits of all. Extra columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, as_before, ascii_lower, rows_of, without, words_of

#: The set of windows is broadcast up to this many rows (some 100 bytes each); a larger one is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000


def _window(words: str, start: str, length: int) -> str:
    return f"array_join(slice({words}, {start} + 1, {length}), ' ')"


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(key, length, items): each distinct window, its number of words, and the ids of the items that have it."""
    words = benchmark.select(F.col("item_id"), words_of(ascii_lower(F.col("text")), ALNUM_WORD).alias("w")).where("size(w) > 0")
    starts = words.select("item_id", "w", F.least(F.size("w"), F.lit(n)).alias("length")).withColumn("start", F.explode_outer(F.expr("sequence(0, size(w) - length)")))
    rows = starts.select("item_id", "length", F.expr("array_join(slice(w, start + 1, length), ' ')").alias("key"))
    return rows.groupBy("key", "length").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, hits): hits are the distinct (start, length, items) of a document's windows in the test set."""
    windows = benchmark_windows(benchmark, n)
    sizes = windows.groupBy("length").count().collect()  # n rows at most
    lengths = sorted(r["length"] for r in sizes) or [n]
    if sum(r["count"] for r in sizes) <= broadcast_windows:
        windows = F.broadcast(windows)
    arrays = [f"if(size(w) < {k}, array(), transform(sequence(0, size(w) - {k}), i -> struct(i AS start, {k} AS length, {_window('w', 'i', k)} AS key)))" for k in lengths]
    made = docs.select("doc_id", words_of(ascii_lower(F.col("text")), ALNUM_WORD).alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"concat(array(struct(-1 AS start, 0 AS length, cast(null AS string) AS key)), {', '.join(arrays)})").alias("at"))
    # explode_outer: for explode(), Spark adds a filter on the size of the array, which makes the array a second time.
    rows = made.select("doc_id", "n_words", F.explode_outer("at").alias("at")).select("doc_id", "n_words", "at.*")
    found = rows.join(windows.select("key", "length", "items"), ["key", "length"], "left").where("start < 0 OR items IS NOT NULL")
    hit = F.when(F.col("start") >= 0, F.struct("start", "length", "items"))
    return found.groupBy("doc_id", "n_words").agg(F.collect_set(hit).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row a document: n_words, n_hit (words inside any hit), items (ids as strings, sorted), positions (word indexes hit)."""
    hits = window_hits(docs, benchmark, n)
    return hits.select(
        "doc_id", "n_words",
        F.expr("array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.length - 1))))").alias("positions"),
        F.expr("array_sort(transform(array_distinct(flatten(transform(hits, h -> h.items))), i -> cast(i AS string)))").alias("items"),
    ).withColumn("n_hit", F.size("positions").cast("long"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """`docs` without contamination. mode "documents": contaminated documents go; "spans": the hit words go from their texts.

    Columns stay as they are. A document id that is null is kept (it can't be traced to a hit row).
    """
    found = contamination(docs, benchmark, n).where("n_hit > 0").select(F.col("doc_id").alias("gone_id"), F.col("positions").alias("hit_at"))
    if mode == "documents":
        return without(docs, found.select("gone_id"))
    pieces = F.regexp_extract_all("text", F.lit(f"({ALNUM_WORD}|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    # Words and gaps alternate: the i-th piece is word i / 2, or (i - 1) / 2 where the text begins with a gap.
    first = F.when(F.col("text").rlike(f"^{ALNUM_WORD}"), 0).otherwise(1)
    joined = rows_of(docs).join(found, F.col("doc_id") == F.col("gone_id"), "left").withColumn("pieces", pieces).withColumn("first", first)
    kept = F.expr("array_join(filter(pieces, (p, i) -> pmod(i - first, 2) = 1 OR NOT array_contains(hit_at, cast((i - first) div 2 AS int))), '')")
    return as_before(joined.withColumn("text", F.when(F.col("gone_id").isNull(), F.col("text")).otherwise(kept)), docs)


def op2(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT item_id, least(len(w), 10) AS n, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM bw),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (
  SELECT doc_id, n, u.i AS i, u.k AS k
  FROM (SELECT doc_id, n, unnest(list_transform(range(0, greatest(len(w) - n + 1, 0)), lambda i: {'i': i, 'k': array_to_string(w[i + 1 : i + n], ' ')})) AS u
        FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN windows USING (n, k)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)
"""
