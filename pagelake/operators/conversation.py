"""Messages, runs and their tools: replay, budgets, evidence and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EVIDENCE = 8
#: Tokens of an image, characters of a result that is always kept, and what stands for one left out.
IMAGE_TOKENS, SHORT_RESULT = 2000, 200
PAGES_LEFT_OUT = ("第 ", "、", " 页原图已省略，如需查看可调用 view_page 重新获取。")
#: The words of an exported conversation.
HEADER, UNTITLED, EXPORTED, SPAN = ("# 《", "》阅读对话"), "未命名书籍", ("> 导出自 ", " · "), "\n> 对话时间："
ASKED, ANSWERED, PASSAGE, REFERENCES = "## 🧑 我", "## 🤖 AI", ("> 📖 引用原文 · 第 ", " 页"), ("> 📚 参考：第 ", "、", " 页")
TEXT_LEFT_OUT = ("此前 ", " 结果约 ", " 字符，已省略")


def retained_runs(messages: DataFrame, budget: int) -> DataFrame:
    """(session_id, run_id, tokens, retained): newest runs until their tokens reach the budget; the one that crosses it stays."""
    tokens = messages.groupBy("session_id", "run_id").agg(F.sum(T.token_estimate(F.col("body"))).alias("tokens"))
    newer = Window.partitionBy("session_id").orderBy(F.col("run_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("retained", F.coalesce(F.sum("tokens").over(newer), F.lit(0)) < budget)


def tool_tokens(text: str = "body", pages: str = "media_pages") -> Column:
    """What a tool's result costs: its text, and IMAGE_TOKENS for each of its images."""
    return T.token_estimate(F.coalesce(F.col(text), F.lit(""))) + IMAGE_TOKENS * F.coalesce(F.greatest(F.size(pages), F.lit(0)), F.lit(0))


def stub(title: str = "title", text: str = "body", pages: str = "media_pages") -> Column:
    """What stands for a tool's result: its pages where it has images, else its title and length."""
    shown = F.concat(F.lit(PAGES_LEFT_OUT[0]), F.array_join(F.col(pages).cast("array<string>"), PAGES_LEFT_OUT[1]), F.lit(PAGES_LEFT_OUT[2]))
    said = F.concat(F.lit(TEXT_LEFT_OUT[0]), F.coalesce(title, F.lit("")), F.lit(TEXT_LEFT_OUT[1]), F.length(F.coalesce(text, F.lit(""))).cast("string"), F.lit(TEXT_LEFT_OUT[2]))
    return F.when(F.size(pages) > 0, shown).otherwise(said)


def elided(tools: DataFrame, retained: DataFrame, oversized: int) -> DataFrame:
    """Tools' results (session_id, run_id, title, body, media_pages array<int>) with `elided` and `saved` tokens, and a stub as
    `body` where they are left out: of more than `oversized` tokens, or outside the retained runs longer than SHORT_RESULT."""
    kept = retained.where("retained").select("session_id", "run_id").withColumn("_kept", F.lit(True))
    met = tools.join(kept, ["session_id", "run_id"], "left")
    cut = (tool_tokens() > oversized) | (F.col("_kept").isNull() & (F.length("body") > SHORT_RESULT))
    cut = F.coalesce(cut, F.lit(False))
    return met.withColumns({"elided": cut, "saved": F.when(cut, tool_tokens() - T.token_estimate(stub())).otherwise(0), "body": F.when(cut, stub()).otherwise(F.col("body"))}).drop("_kept")


def replay(messages: DataFrame) -> DataFrame:
    """(…, position): usable messages in order; questions all, answers only if not blank and their run has a question, others of the run before the answer."""
    usable = messages.where((F.col("role") == "user") | (F.trim("body") != ""))
    kind = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    order = Window.partitionBy("session_id").orderBy("run_id", kind, "turn")
    return usable.where("run_id > 0").withColumn("position", F.row_number().over(order))


def top_evidence(hits: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(answer_id, page, score, place): the best hit of each page, the `most` best of these, by page."""
    per_page = hits.groupBy("answer_id", "page").agg(F.max("score").alias("score"))
    best = Window.partitionBy("answer_id").orderBy(F.col("score").desc(), "page")
    top = per_page.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).drop("r")
    return top.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("page")))


def inherited(answers: DataFrame, column: str) -> DataFrame:
    """`answers` with `column` taken from the last earlier answer of the session that has it, where null."""
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return answers.withColumn(column, F.last(column, ignorenulls=True).over(before))


def exported(messages: DataFrame, titles: DataFrame, day: Column, exporter: str = "pagelake") -> DataFrame:
    """(session_id, n_messages, markdown): a conversation as a text with a header, the days it spans and its turns.

    messages: (session_id, turn, role, status, body, passage_page, evidence_pages, created_at); titles: (session_id, title).
    All questions are there, answers only if they are complete. A question names the page it quotes, an answer its pages of
    evidence, each once and in order. `created_at` is a timestamp, null where none is known. A session without a message
    to show is its header.
    """
    said = messages.where((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("status") == "complete")))
    asked = F.col("role") == "user"
    pages = F.array_sort(F.array_distinct("evidence_pages"))
    quoted = F.when(asked & F.col("passage_page").isNotNull(), F.concat(F.lit(PASSAGE[0]), F.col("passage_page").cast("string"), F.lit(PASSAGE[1])))
    named = F.when(~asked & (F.size(pages) > 0), F.concat(F.lit(REFERENCES[0]), F.array_join(pages.cast("array<string>"), REFERENCES[1]), F.lit(REFERENCES[2])))
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")
    line = F.concat_ws("\n\n", F.when(asked, ASKED).otherwise(ANSWERED), body, quoted, named)
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    per = said.groupBy("session_id").agg(F.count("*").alias("n"), F.transform(turns, lambda t: t["line"]).alias("lines"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    met = titles.select("session_id", "title").join(per.withColumnRenamed("session_id", "_s"), F.col("session_id") == F.col("_s"), "left")
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    title = F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\r\n\t]+", " "), r"^\s+|\s+$", ""), F.lit(""))
    head = F.concat(F.lit(HEADER[0]), F.coalesce(title, F.lit(UNTITLED)), F.lit(HEADER[1]), F.lit(f"\n\n{EXPORTED[0]}{exporter}{EXPORTED[1]}"), date(day))
    span = F.when(date("first") == date("last"), date("first")).otherwise(F.concat(date("first"), F.lit(" ~ "), date("last")))
    span = F.coalesce(F.concat(F.lit(SPAN), span), F.lit(""))
    text = F.concat(head, span, F.lit("\n\n"), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n\n"), F.lit("\n"))
    return met.select("session_id", F.coalesce("n", F.lit(0)).alias("n_messages"), text.alias("markdown"))
