"""Where rows come from: the given tables seen as books, pages, messages and traces, and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE_KINDS = ("view", "click", "purchase", "signup", "logout", "error")
MOST_BROADCAST = 50_000
PAGE_BLOCK = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it has at most MOST_BROADCAST rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def book_pages(documents: DataFrame, held: str = "text") -> DataFrame:
    """(book_id, page, doc_id, text): a source is a book, its documents in order are pages from 1. held: another column in place of text.

    Pages are counted in blocks of PAGE_BLOCK ids, and a row with the pages before a block precedes its documents. So the
    texts of a large source are sorted in many tasks, in one shuffle; only a number for each block meets by source.
    """
    block = F.expr(f"doc_id div {PAGE_BLOCK}").alias("block")
    blocks = documents.groupBy("source", block).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = documents.select("source", block, "doc_id", held).unionByName(first, allowMissingColumns=True)
    order = Window.partitionBy("source", "block").orderBy(F.col("before").isNull(), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    page = F.max("before").over(order) + F.sum(F.col("before").isNull().cast("int")).over(order)
    return rows.select(F.col("source").alias("book_id"), page.cast("int").alias("page"), "doc_id", held, "before").where("before IS NULL").drop("before")


def messages(conversations: DataFrame) -> DataFrame:
    """(session_id, turn, run_id, role, body): a run begins with each user turn."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order)
    return conversations.select(F.col("conv_id").alias("session_id"), "turn", run.alias("run_id"), "role", F.col("text").alias("body"))


def book_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, book_id, bytes) of the PDF files below a path; a book's id is the digest of its bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("book_id"), F.col("length").alias("bytes"))


def traces(lines: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(ts, kind, data) of a column of JSON lines, batch or streaming; broken lines and unknown kinds are skipped."""
    parsed = lines.select(F.from_json("value", "ts string, kind string, data string").alias("t")).select("t.*")
    parsed = parsed.where("kind IS NOT NULL AND ts IS NOT NULL")
    parsed = parsed.where(F.col("kind").isin(kinds)) if kinds else parsed
    return parsed.select(F.to_timestamp("ts").alias("ts"), "kind", F.coalesce("data", F.lit("{}")).alias("data"))
