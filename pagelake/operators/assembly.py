"""Conversations assembled for a model: tool rows beside their answers, summaries first, the question last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts and limits of messages.
SUMMARY_HEAD = "【Conversation Summary】\n"
INTERRUPTED = "程序中断，回答未完成。"
TRUNCATED = "…（已截断）"
SNAPSHOT_CHARS = 200_000
MOST_IMAGES, IMAGE_BYTES, TOTAL_BYTES = 4, 8 << 20, 24 << 20
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")


def as_read(messages: DataFrame) -> DataFrame:
    """`messages` (…, status, error, focus) as a reader sees them: what was still streaming is cancelled; `passage_page` and
    `passage` come from the focus, JSON that may be broken."""
    streaming = F.col("status") == "streaming"
    focus = F.from_json("focus", "selectedPassage struct<page: int, text: string>")
    rest = [c for c in messages.columns if c not in ("status", "error", "focus")]
    return messages.select(*rest, F.when(streaming, "cancelled").otherwise(F.col("status")).alias("status"), F.when(streaming, INTERRUPTED).otherwise(F.col("error")).alias("error"), focus["selectedPassage"]["page"].alias("passage_page"), focus["selectedPassage"]["text"].alias("passage"))


def usable(role: Column, status: Column) -> Column:
    """Questions always, answers only when complete."""
    return (role == "user") | (status == "complete")


def replayed(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """(session_id, turn, step, role, content): the usable messages (session_id, turn, run_id, role, status, body) in order.

    The tool rows (run_id, at, seq, call, result) of a complete answer's run stand before it, a call and its result each;
    of two answers of one run the first has them. Tool rows of other runs are left out.
    """
    kept = messages.where(usable(F.col("role"), F.col("status")))
    answers = kept.where("role <> 'user'").groupBy("session_id", "run_id").agg(F.min("turn").alias("turn"))
    rows = tools.join(answers, ["session_id", "run_id"])
    pair = F.array(F.struct(F.lit(0).alias("k"), F.lit("assistant").alias("role"), F.col("call").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("tool").alias("role"), F.col("result").alias("content")))
    each = rows.select("session_id", "turn", "at", "seq", F.explode(pair).alias("p")).select("session_id", "turn", F.lit(0).alias("kind"), "at", "seq", "p.k", "p.role", "p.content")
    own = kept.select("session_id", "turn", F.lit(1).alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("k"), "role", F.col("body").alias("content"))
    every = each.select("session_id", "turn", "kind", "at", F.col("seq").cast("long").alias("seq"), "k", "role", "content").union(own)
    ordered = F.array_sort(F.collect_list(F.struct("kind", "at", "seq", "k", "role", "content")))
    return every.groupBy("session_id", "turn").agg(ordered.alias("m")).select("session_id", "turn", F.posexplode("m").alias("step", "m")).select("session_id", "turn", "step", "m.role", "m.content")


def context(replay: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, place, role, content): the summary of each session (session_id, summary, question) if it has one, its replay, the question."""
    head = sessions.where("trim(summary) <> ''").select("session_id", F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("step"), F.lit("user").alias("role"), F.concat(F.lit(SUMMARY_HEAD), F.trim("summary")).alias("content"))
    tail = sessions.select("session_id", F.lit(2**62).alias("turn"), F.lit(0).alias("step"), F.lit("user").alias("role"), F.col("question").alias("content"))
    every = head.union(replay.select("session_id", F.col("turn").cast("long"), "step", "role", "content")).union(tail)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "step", "role", "content")))
    return every.groupBy("session_id").agg(ordered.alias("m")).select("session_id", F.posexplode("m").alias("place", "m")).select("session_id", "place", "m.role", "m.content")


def session_entries(messages: DataFrame) -> DataFrame:
    """(id, parent_id, timestamp, role, content) of the usable messages (id, created_at, role, status, body)."""
    return messages.where(usable(F.col("role"), F.col("status"))).select("id", F.lit(None).cast("string").alias("parent_id"), F.col("created_at").alias("timestamp"), "role", F.col("body").alias("content"))


def effective(window: Column, keep_recent: Column) -> Column:
    """struct<reserve, keep, oversized>: tokens kept free for the answer, kept of recent turns, and above which a tool row is left out."""
    reserve = F.floor(window * 0.3 + 0.5).cast("long")
    keep = F.greatest(F.lit(1), F.least(keep_recent, window - reserve - 1000))
    return F.struct(reserve.alias("reserve"), keep.cast("long").alias("keep"), F.greatest(F.lit(2000), F.floor(window * 0.25)).cast("long").alias("oversized"))


def budget_warning(used: Column, total: Column) -> Column:
    return F.format_string("系统提示：你已使用 %d/%d 轮。请把重要发现整理好带进最终回答，并继续任务——不要因为这个提示就停下来。", used, total)


def truncated(text: Column, most: int = SNAPSHOT_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def redacted(blocks: Column) -> Column:
    """Content blocks (array<struct<type, text, mime, data>>) as texts; an image's bytes give way to a note of their size."""
    size = lambda b: F.floor(F.length(F.coalesce(b["data"], F.lit(""))) * 3 / 4 / 1024 + 0.5).cast("int")
    return F.transform(blocks, lambda b: F.when(b["type"] == "image", F.format_string("[图片已省略：%s，约 %d KB]", F.coalesce(b["mime"], F.lit("unknown")), size(b))).otherwise(b["text"]))


def attachments_valid(requests: DataFrame) -> DataFrame:
    """(request_id, valid, bytes) of attachments (request_id, id, mime, bytes): at most four images of known types with distinct ids, each and all within limits."""
    each = F.col("id").isNotNull() & F.length("id").between(1, 128) & F.col("mime").isin(*IMAGE_TYPES) & F.col("bytes").between(1, IMAGE_BYTES)
    n, total = F.count("*"), F.sum("bytes")
    valid = F.bool_and(F.coalesce(each, F.lit(False))) & (n <= MOST_IMAGES) & (F.count_distinct("id") == n) & (total <= TOTAL_BYTES)
    return requests.groupBy("request_id").agg(valid.alias("valid"), total.alias("bytes"))


def of_run(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The buffered `events` (run_id, …) of runs that have started by now."""
    return events.join(runs.select("run_id").distinct(), "run_id", "left_semi")
