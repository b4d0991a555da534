"""Changes to several tables at once: all of a change shows, or none of it.

A change has a number. Its rows and its removals are Parquet files under that number in every table, written over if they
are tried again; last comes a row in `done`. Readers take the numbers that are done, of each key the row of the greatest,
and of those the ones no later removal covers. So a change that was cut short is not there, and the next takes its number.
A removal names the first columns of a table's key: a book, or a page of a book, and what a change removes and writes anew
in the same key is there. One writer at a time: a stream, or a caller between its batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The tables by name: what they hold, and how many of the first columns are the key.
LIBRARY = {
    "books": ("book_id string, dirty boolean", 1),
    "pages": ("book_id string, page long, text string", 2),
    "postings": ("book_id string, page long, token string, positions array<int>", 3),
    "vectors": ("book_id string, page long, chunk string, embedding array<double>", 3),
    "messages": ("book_id string, session_id string, turn long, body string", 3),
}
_DONE, _REMOVALS = "change long, source string, batch long", "change long, name string, depth int, scope string"


def _scope(columns: list[str]) -> Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


@dataclass
class Tables:
    """Tables (name: columns and length of key) below `root`, a folder that all executors share."""

    spark: SparkSession
    root: str
    tables: dict[str, tuple[str, int]]

    def _read(self, name: str, schema: str) -> DataFrame:
        spark = self.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/change={number}")

    def done(self) -> DataFrame:
        """(change, source, batch) of the changes that are whole."""
        return self._read("done", _DONE)

    def columns(self, name: str) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.tables[name][0].split(",")]

    def key(self, name: str) -> list[str]:
        return self.columns(name)[: self.tables[name][1]]

    def apply(self, rows: dict[str, DataFrame], removals: dict[str, list[DataFrame]] | None = None, source: str = "", batch: int | None = None) -> int:
        """Writes a change and gives its number. rows: new rows by table; removals: by table, frames of the first columns of its key.

        A batch of a source that is done already is not written again.
        """
        done = self.done()
        again = done.where((F.col("source") == source) & (F.col("batch") == batch)).first() if batch is not None else None
        if again:
            return again["change"]
        number = (done.agg(F.max("change")).first()[0] or 0) + 1
        gone = self.spark.createDataFrame([], "name string, depth int, scope string")
        for name, frames in (removals or {}).items():
            for frame in frames:
                of_key = self.key(name)[: len(frame.columns)]
                gone = gone.union(frame.select(F.lit(name).alias("name"), F.lit(len(of_key)).alias("depth"), _scope(of_key).alias("scope")))
        self._write(gone.distinct(), "removals", number)
        for name, (schema, _) in self.tables.items():
            # Every table, though it be with no row: an attempt that was cut short may have left rows under this number.
            self._write(rows[name].select(*self.columns(name)) if name in rows else self.spark.createDataFrame([], schema), name, number)
        self._write(self.spark.createDataFrame([(source, batch)], "source string, batch long"), "done", number)
        return number

    def current(self, name: str) -> DataFrame:
        """A table's rows as they stand."""
        key, rest = self.key(name), self.columns(name)[self.tables[name][1] :]
        done = self.done().select("change")
        rows = self._read(name, f"{self.tables[name][0]}, change long").join(done, "change", "left_semi")
        last = rows.groupBy(*key).agg(F.max(F.struct("change", *rest)).alias("_last")).select(*key, "_last.*")
        removals = self._read("removals", _REMOVALS).where(F.col("name") == name).join(done, "change", "left_semi")
        latest = removals.groupBy("depth", "scope").agg(F.max("change").alias("_gone"))
        for depth in sorted(r[0] for r in removals.select("depth").distinct().collect()):  # lengths of keys
            own = latest.where(F.col("depth") == depth).select(F.col("scope").alias("_scope"), "_gone")
            last = last.join(own, _scope(key[:depth]) == F.col("_scope"), "left").where("_gone IS NULL OR change >= _gone").drop("_scope", "_gone")
        return last.select(*self.columns(name))


def postings_of(pages: DataFrame) -> DataFrame:
    """(book_id, page, token, positions) of pages (book_id, page, text)."""
    words = pages.select("book_id", "page", F.posexplode(T.word_tokens(F.col("text"))).alias("at", "token"))
    return words.groupBy("book_id", "page", "token").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def recognised(tables: Tables, pages: DataFrame, source: str = "recognised", batch: int | None = None) -> int:
    """Recognised pages (book_id, page, text) take the place of what was known of them: text and postings are theirs, their
    vectors go, their books are to be embedded again. Pages below 1 or without a text are none; of several texts of a page
    the greatest stays."""
    good = pages.where("page >= 1 AND text IS NOT NULL").groupBy("book_id", F.col("page").cast("long").alias("page")).agg(F.max("text").alias("text"))
    named = good.select("book_id", "page")
    rows = {"pages": good, "postings": postings_of(good), "books": good.select("book_id", F.lit(True).alias("dirty")).distinct()}
    return tables.apply(rows, {"postings": [named], "vectors": [named]}, source, batch)


def recognised_stream(tables: Tables, pages: DataFrame, checkpoint: str, source: str = "recognised"):
    """A stream of recognised pages, each micro-batch one change; a batch that is tried again is the same change."""
    return pages.writeStream.foreachBatch(lambda batch, number: recognised(tables, batch, source, number) and None).option("checkpointLocation", checkpoint).start()


def books_deleted(tables: Tables, books: DataFrame) -> int:
    """All rows of books (book_id) go from every table."""
    asked = books.select("book_id").distinct()
    return tables.apply({}, {name: [asked] for name in tables.tables if tables.key(name)[0] == "book_id"})


def conversations_cleared(tables: Tables, sessions: DataFrame) -> int:
    """All messages of sessions (book_id, session_id) go."""
    return tables.apply({}, {"messages": [sessions.select("book_id", "session_id").distinct()]})
