"""Background jobs and incremental builds as set operations: admission, replacement, recovery, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Priorities of the jobs that opening a book starts.
OPENING = {"outline": 25, "ocr": 20, "index": 10, "embedding": 0}
MOST_PRIORITY, MOST_ATTEMPTS, ATTEMPTS, MOST_TEXT, NATIVE_LEAST = 100, 5, 3, 256, 16


def admitted(requests: DataFrame, kinds=tuple(OPENING)) -> DataFrame:
    """Requests (book_id, kind, priority, max_attempts, input_version, ...) of known kinds, their numbers within bounds, a version too long dropped."""
    within = lambda c, low, high, none: F.when(F.col(c).isNull(), none).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col(c))))
    rows = requests.where(F.col("book_id").isNotNull() & F.col("kind").isin(*kinds))
    rows = rows.withColumn("priority", within("priority", -MOST_PRIORITY, MOST_PRIORITY, 0)).withColumn("max_attempts", within("max_attempts", 1, MOST_ATTEMPTS, ATTEMPTS))
    return rows.withColumn("input_version", F.when(F.length("input_version") <= MOST_TEXT, F.col("input_version")))


def scheduled(requests: DataFrame) -> DataFrame:
    """(book_id, kind, seq, status, input_version, priority, max_attempts, asked): the jobs that requests in the order of `seq` make.

    At most one job of a book and kind is active. A request without a version, or with the active job's, meets that
    job; another version cancels it and makes a new one. asked: requests that a job has met. An interactive text
    recognition (priority above 0) is on top of this: see `paused`.
    """
    order = Window.partitionBy("book_id", "kind").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("_v", F.last("input_version", ignorenulls=True).over(before)).withColumn("_first", F.row_number().over(order) == 1)
    new = F.col("_first") | (F.col("input_version").isNotNull() & ~F.col("input_version").eqNullSafe(F.col("_v")))
    rows = rows.withColumn("_job", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    jobs = rows.groupBy("book_id", "kind", "_job").agg(F.min("seq").alias("seq"), F.min_by("input_version", "seq").alias("input_version"), F.min_by("priority", "seq").alias("priority"), F.min_by("max_attempts", "seq").alias("max_attempts"), F.count("*").alias("asked"))
    last = F.row_number().over(Window.partitionBy("book_id", "kind").orderBy(F.col("_job").desc())) == 1
    return jobs.select("book_id", "kind", "seq", F.when(last, "queued").otherwise("cancelled").alias("status"), "input_version", "priority", "max_attempts", "asked")


def paused(jobs: DataFrame) -> DataFrame:
    """`jobs` (id, kind, priority, status, created): running ones are paused where an interactive recognition of higher priority came later."""
    top = jobs.where("kind = 'ocr' AND priority > 0 AND status = 'queued'").agg(F.max(F.struct("priority", "created")).alias("t"))
    lower = (F.col("status") == "running") & (F.col("priority") < F.col("t.priority")) & (F.col("created") <= F.col("t.created"))
    return jobs.crossJoin(F.broadcast(top)).withColumn("status", F.when(lower, "paused").otherwise(F.col("status"))).drop("t")  # one row


def recovered(status: Column) -> Column:
    """What a job is after a crash: what ran is queued again."""
    return F.when(status == "running", "queued").otherwise(status)


def opening_jobs(books: DataFrame) -> DataFrame:
    """(book_id, kind, priority): the jobs that opening each book asks for."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("priority")) for k, p in OPENING.items()])
    return books.select("book_id", F.explode(kinds).alias("j")).select("book_id", "j.*")


def finalised(messages: DataFrame, runs: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, tool rows) after runs (run_id, owner, status, body) end.

    A message is rewritten only while it streams and belongs to the run's owner; tool rows (run_id, at, id) that end with it are numbered from 1.
    """
    end = runs.select(F.col("run_id").alias("_r"), F.col("owner").alias("_o"), F.col("status").alias("_s"), F.col("body").alias("_b"))
    met = messages.join(end, F.col("run_id") == F.col("_r"), "left")
    mine = F.col("_r").isNotNull() & (F.col("status") == "streaming") & (F.col("owner") == F.col("_o"))
    kept = [c for c in messages.columns if c not in ("status", "body")]
    written = met.select(*kept, F.when(mine, F.col("_s")).otherwise(F.col("status")).alias("status"), F.when(mine, F.col("_b")).otherwise(F.col("body")).alias("body"))
    order = Window.partitionBy("run_id").orderBy("at", "id")
    numbered = tools.join(runs.select("run_id"), "run_id", "left_semi").withColumn("seq", F.row_number().over(order))
    return written, numbered


def embedding_plan(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(chunk_id, action): 'new', 'changed' (another text), 'model' (another model) or 'keep' for chunks (chunk_id, hash), 'stale' for other vectors (chunk_id, hash, model)."""
    have = vectors.select(F.col("chunk_id").alias("_c"), F.col("hash").alias("_h"), F.col("model").alias("_m"))
    met = chunks.join(have, F.col("chunk_id") == F.col("_c"), "full")
    action = F.when(F.col("chunk_id").isNull(), "stale").when(F.col("_c").isNull(), "new").when(F.col("hash") != F.col("_h"), "changed").when(F.col("_m") != model, "model").otherwise("keep")
    return met.select(F.coalesce("chunk_id", "_c").alias("chunk_id"), action.alias("action"))


def embedded(chunks: DataFrame, vectors: DataFrame, model: str, embed) -> DataFrame:
    """The vectors after an incremental build: kept ones, and `embed(chunks)` -> (chunk_id, vector) for what is new or outdated."""
    plan = embedding_plan(chunks, vectors, model)
    todo = chunks.join(plan.where("action IN ('new', 'changed', 'model')"), "chunk_id", "left_semi")
    fresh = embed(todo).join(todo.select("chunk_id", "hash"), "chunk_id").select("chunk_id", "hash", F.lit(model).alias("model"), "vector")
    kept = vectors.join(plan.where("action = 'keep'"), "chunk_id", "left_semi").select("chunk_id", "hash", "model", "vector")
    return kept.union(fresh)


def needs_embedding(books: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """`books` (book_id, dirty) that are dirty or have no vector of the model."""
    current = vectors.where(F.col("model") == model).select(F.col("book_id").alias("_b")).distinct()
    return books.join(current, F.col("book_id") == F.col("_b"), "left").where("dirty OR _b IS NULL").select(*books.columns)


def page_texts(native: Column, recognised: Column) -> Column:
    """A page's own text if it is long enough, else what was recognised, else the short one."""
    return F.when(F.length(F.trim(native)) >= NATIVE_LEAST, native).when(F.length(F.trim(recognised)) > 0, recognised).otherwise(F.coalesce(native, F.lit("")))


def index_work(pages: DataFrame, indexed: DataFrame, version: int) -> DataFrame:
    """(book_id, page, text): pages (book_id, page, native, recognised) that an index of the version still needs.

    Rows of other versions don't count; work resumes behind the contiguous prefix of pages that are there.
    """
    good = indexed.where(F.col("version") == version).select("book_id", "page").distinct()
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("page"))
    prefix = good.withColumn("_r", place).where("page = _r").groupBy("book_id").agg(F.max("page").alias("done")).withColumnRenamed("book_id", "_b")
    rows = pages.join(prefix, F.col("book_id") == F.col("_b"), "left").where(F.col("page") > F.coalesce("done", F.lit(0)))
    return rows.select("book_id", "page", page_texts(F.col("native"), F.col("recognised")).alias("text"))


def postings_replaced(postings: DataFrame, changed: DataFrame, tokens) -> DataFrame:
    """Postings (book_id, page, token, n) after pages (book_id, page, text) change: theirs go, `tokens(text)` of pages with text come."""
    kept = postings.join(changed.select("book_id", "page"), ["book_id", "page"], "left_anti")
    fresh = changed.where("trim(text) <> ''").select("book_id", "page", F.explode(tokens(F.col("text"))).alias("token")).groupBy("book_id", "page", "token").agg(F.count("*").alias("n"))
    return kept.select("book_id", "page", "token", "n").union(fresh.select("book_id", "page", "token", "n"))


def pages_to_recognise(required: DataFrame, cache: DataFrame, engine: str, model: str) -> DataFrame:
    """`required` (book_id, page, input_hash, input_version) without a compatible cached result: the same input, engine and model."""
    good = cache.where((F.col("engine") == engine) & (F.col("model") == model)).select("input_hash", "input_version").distinct()
    return required.join(good, ["input_hash", "input_version"], "left_anti").select(*required.columns)


def invalidated(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """`pages` (book_id, page, ...) but for those asked (book_id, page): a page, or with a null page the whole book."""
    whole = asked.where("page IS NULL").select("book_id").distinct()
    return pages.join(whole, "book_id", "left_anti").join(asked.where("page IS NOT NULL").select("book_id", "page").distinct(), ["book_id", "page"], "left_anti").select(*pages.columns)
