"""Tool runs, traces and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Retired tool names and what they are called now; what ends a run, by what set it off; a checkpoint's mark.
TOOL_NAMES = {"book_search": "search_book", "read_page_image": "view_page", "web_search": "search_web"}
EXIT_REASONS = {"max_iterations": "max_iterations_reached", "loop_detected": "loop_detected", "wall_clock_total": "wall_clock_timeout", "wall_clock_idle": "wall_clock_timeout"}
CHECKPOINT = "ocr-linear:"


def found_and_missing(requested: DataFrame, indexed: DataFrame) -> DataFrame:
    """`requested` (book_id, page) with `found`: whether the index has the page."""
    have = indexed.select("book_id", "page").distinct().withColumn("found", F.lit(True))
    return requested.join(have, ["book_id", "page"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def current_name(tool: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TOOL_NAMES.items() for x in pair])
    return F.coalesce(names[tool], tool)


def exit_reason(exhausted: Column, failure: Column, trigger: Column, answered: Column) -> Column:
    """The first that holds: the last attempts brought nothing, cancelled, failed, a guard went off, no answer; else completed.

    failure: "cancelled", "error" or null; trigger: a key of EXIT_REASONS or null.
    """
    reasons = F.create_map(*[F.lit(x) for pair in EXIT_REASONS.items() for x in pair])
    ended = F.when(exhausted, "all_retries_exhausted_no_response").when(failure == "cancelled", "interrupted_by_user").when(failure == "error", "error")
    return ended.when(trigger.isNotNull(), reasons[trigger]).when(~F.coalesce(answered, F.lit(False)), "unknown").otherwise("completed")


def without_late(results: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Results (key, ts) that are not behind their key's first cancellation (key, ts)."""
    first = cancelled.groupBy("key").agg(F.min("ts").alias("cancelled_at"))
    return results.join(first, "key", "left").where("cancelled_at IS NULL OR ts <= cancelled_at").drop("cancelled_at")


def fenced(writes: DataFrame, claims: DataFrame) -> DataFrame:
    """Checkpoint writes (job_id, claim_id, progress, total) of those who hold the job's running claim, progress within [0, total]."""
    held = claims.where("status = 'running'").select("job_id", "claim_id")
    return writes.join(held, ["job_id", "claim_id"], "left_semi").withColumn("progress", F.least(F.greatest(F.col("progress"), F.lit(0)), F.col("total")))


def spent(attempts: DataFrame, cost: str, keys: list[str], order: list[str], most: int) -> DataFrame:
    """`attempts` with `allowed`: whether all up to and with this one cost no more than `most`."""
    running = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return attempts.withColumn("allowed", running <= most)


def last_of(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def question_of(messages: DataFrame) -> DataFrame:
    """(session_id, turn, question_turn): the last question before each answer."""
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before)
    return messages.withColumn("question_turn", asked).where("role = 'assistant'").select("session_id", "turn", "question_turn")


def checkpoint(completed: Column) -> Column:
    """How many leading pages are done, as text; null, negative and broken numbers are none."""
    whole = F.when(F.isnan(completed.cast("double")), 0).otherwise(F.greatest(F.lit(0), F.floor(F.coalesce(completed, F.lit(0)))))
    return F.concat(F.lit(CHECKPOINT), whole.cast("long").cast("string"))


def checkpoint_prefix(text: Column) -> Column:
    """The number of a checkpoint; any other text, also of an older form, means none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, rf"^{CHECKPOINT}([0-9]+)\z", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def outline_entries(reply: Column) -> Column:
    """Valid entries of a model's reply: JSON, fenced or bare, with label (2-80), level (1-3) and printed (0-9999)."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "entries array<struct<label: string, level: int, printed: int>>")["entries"]
    return F.filter(parsed, lambda e: F.length(F.trim(e["label"])).between(2, 80) & e["level"].between(1, 3) & (e["printed"].isNull() | e["printed"].between(0, 9999)))


def anchored(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """Contents rows (book_id, ord, ordinal, title_key) with the page of the first heading of the ordinal, else of the title."""
    by = lambda key: headings.where(F.col(key).isNotNull()).groupBy("book_id", F.col(key).alias(f"h_{key}")).agg(F.min(F.struct("page", "ord")).alias(f"at_{key}"))
    one = rows.join(by("ordinal").withColumnRenamed("book_id", "b1"), (F.col("book_id") == F.col("b1")) & (F.col("ordinal") == F.col("h_ordinal")), "left")
    two = one.join(by("title_key").withColumnRenamed("book_id", "b2"), (F.col("book_id") == F.col("b2")) & (F.col("title_key") == F.col("h_title_key")), "left")
    return two.select("book_id", "ord", F.coalesce("at_ordinal.page", "at_title_key.page").alias("page"))


def yields(probe: DataFrame, books: DataFrame, gap: int = 2, window: int = 30) -> DataFrame:
    """(book_id, yields): whether the contents pages of books (book_id, total, scanned) are known to be over.

    probe: (book_id, page, has_index); scanned: how many leading pages were looked at. They are once the window is scanned,
    `window` pages or the whole of a shorter book, or once `gap` scanned pages of the window behind the last with an index have none.
    """
    end = F.least(F.col("total"), F.lit(window))
    met = probe.join(books, "book_id").where(F.col("page").between(F.lit(1), end))
    last = met.where("has_index").groupBy("book_id").agg(F.max("page").alias("last_index"))
    behind = F.col("page").between(F.col("last_index") + 1, F.col("last_index") + gap) & (F.col("page") <= F.col("scanned")) & ~F.col("has_index")
    clear = met.join(last, "book_id").groupBy("book_id").agg(F.count_if(behind).alias("clear"))
    per = books.join(clear, "book_id", "left")
    return per.select("book_id", ((end > 0) & ((F.col("scanned") >= end) | (F.coalesce("clear", F.lit(0)) == gap))).alias("yields"))


def increasing(nodes: DataFrame) -> DataFrame:
    """(book_id, increasing): whether roots' pages strictly rise."""
    step = F.col("page") - F.lag("page").over(Window.partitionBy("book_id").orderBy("ord"))
    return nodes.where("depth = 1 AND page IS NOT NULL").withColumn("step", step).groupBy("book_id").agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("increasing"))
