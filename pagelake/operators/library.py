"""The library's tables: which books are shown, what deleting takes along, signatures of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with `name`: their place in the whole order, from 1. Rows are dealt out by ranges of the order and counted within
    each; a range begins where the counts of those before end, so no task sorts all."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id's upper bits are the range, its lower ones the row's number there; written, so that both stay as they are.
    numbered = written(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part, number = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(F.broadcast(bases), part == F.col("_part")).withColumn(name, F.col("_base") + number + 1).drop("_id", "_part", "_base")


def shelf(books: DataFrame, most: int | None = None) -> DataFrame:
    """Books (book_id, in_library, updated_at) that are in the library, latest first, then by id; with `place` from 1, `most` at most."""
    order = [F.col("updated_at").desc(), F.col("book_id").asc()]
    shown = books.where("in_library")
    return placed(shown.orderBy(*order).limit(most) if most else shown, order, "place")


def removed(books: DataFrame, asked: DataFrame) -> DataFrame:
    """`books` with those asked (book_id) out of the library; their rows stay."""
    gone = asked.select(F.col("book_id").alias("_b")).distinct()
    met = books.join(gone, F.col("book_id") == F.col("_b"), "left")
    return met.withColumn("in_library", F.col("in_library") & F.col("_b").isNull()).select(*books.columns)


def opened(books: DataFrame, book: DataFrame) -> DataFrame:
    """(book_id, path, page_count) of the active books asked for (book_id)."""
    return books.where("in_library").join(book.select("book_id").distinct(), "book_id", "left_semi").select("book_id", "path", "page_count")


def of_version(rows: DataFrame, book: str, version: int) -> DataFrame:
    return rows.where((F.col("book_id") == book) & (F.col("extraction_version") == version))


def compatible(rows: DataFrame, engine: str, model: str, version: str) -> Column:
    """Whether a recognised page of `rows` may be used as it is."""
    return (rows["engine"] == engine) & (rows["model"] == model) & (rows["input_version"] == version)


def signatures(rows: DataFrame) -> DataFrame:
    """(book_id, n, latest): tells whether what is stored of a book has changed; latest is '' where nothing has a time."""
    return rows.groupBy("book_id").agg(F.count("*").alias("n"), F.coalesce(F.max("updated_at"), F.lit("")).alias("latest"))


def cleared(session: str, runs: DataFrame, tools: DataFrame, messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, ...]:
    """(runs, tools, messages, sessions) without a session's conversation; the session stays, without summary and anchors."""
    gone = runs.where(F.col("session_id") == session).select("run_id")
    here = F.col("session_id") == session
    kept = [F.when(~here, F.col(c)).alias(c) if c in ("summary", "anchor_id") else F.col(c) for c in sessions.columns]
    return runs.where(~here), tools.join(gone, "run_id", "left_anti"), messages.where(~here), sessions.select(*kept)


def without_source(vectors: DataFrame, source: str = "conversation") -> DataFrame:
    return vectors.where(~F.col("source").eqNullSafe(F.lit(source)))


def failed_books(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'failed'").select("book_id").distinct()


def merged_candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a candidate: its longest text, the first by order on ties, and its smallest source."""
    return rows.groupBy(*keys).agg(F.max_by("text", F.struct(F.length("text").alias("n"), F.col("text"))).alias("text"), F.min("source_id").alias("source_id"))
