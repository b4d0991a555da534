"""What several operators share: tables in the shared folder, byte-exact word patterns, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the decontamination contract: anything but ASCII that is neither letter nor digit.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the Jaccard and mixing contracts: anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Texts are long, so Arrow batches of them are bounded by bytes (unless the session says how) and stay far below a worker's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def rows_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): whole rows beside what operators read, so that no other column's name can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, with the `text` of `df`."""
    return df.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` but for rows whose doc_id `gone` has as `gone_id`."""
    return as_before(rows_of(docs).join(few(gone), F.col("doc_id") == F.col("gone_id"), "left_anti"), docs)


#: Ids are broadcast up to this many (16 bytes each), else joined by shuffle.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A table of ids, written, and marked for broadcast if it is no longer than BROADCAST_IDS."""
    ids = written(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, so that the result doesn't depend on a locale or Unicode version."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, pattern: str) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def components(edges: DataFrame, spark: SparkSession, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Each round gives every node the least label among its neighbours and itself, then follows labels once, so long
    chains shorten by half; a round is two joins whose keys may be hot, which Spark's skew handling splits.
    Self links and repeated links change nothing; no link gives no row.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    first = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = written(first.select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = written(step.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("component"), "old"))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components still change after {rounds} rounds")
