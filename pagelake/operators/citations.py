"""Whether quotes and page claims of answers are grounded in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import containing

#: How long quotes are, how much of one is shown, what a page claim and a quote look like.
LEAST_QUOTE, MOST_QUOTE, EXCERPT = 6, 160, 60
CLAIMED = r"第\s*(\d{1,4})\s*页"
QUOTED = r"[「“]([^「」“”]{6,160})[」”]|\"([^\"\n]{6,160})\"|《([^《》]{6,160})》"

#: Parts in which the answers that name a page are gathered.
PARTS = 64


def _excerpt(quote: str) -> F.Column:
    return F.when(F.length(quote) > EXCERPT, F.concat(F.left(quote, F.lit(EXCERPT)), F.lit("…"))).otherwise(F.col(quote))


def grounded(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, n_pages, first_page_id, excerpt): pages that contain each quote in match form. quotes: (quote_id, quote); pages: (page_id, text).

    A quote without letters and digits is on no page.
    """
    wanted = quotes.select("quote_id", T.match_form(F.col("quote")).alias("q")).where("q <> ''")
    corpus = pages.select("page_id", T.match_form(F.col("text")).alias("m"))
    found = containing(corpus, wanted).groupBy("q").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page_id"))
    by_quote = wanted.join(found, "q").drop("q")
    return quotes.join(by_quote, "quote_id", "left").select("quote_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "first_page_id", _excerpt("quote").alias("excerpt"))


def page_claims(answers: DataFrame, least: int = 1) -> DataFrame:
    """(answer_id, book_id, page): the distinct pages from `least` on that answers (answer_id, book_id, body) name."""
    numbers = F.regexp_extract_all("body", F.lit(CLAIMED), F.lit(1))
    return answers.select("answer_id", "book_id", F.explode(F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))).alias("page")).where(F.col("page") >= least)


def answer_quotes(answers: DataFrame) -> DataFrame:
    """(answer_id, book_id, i, quote): what answers quote, in order, trimmed, LEAST_QUOTE characters or more."""
    groups = [F.regexp_extract_all("body", F.lit(QUOTED), F.lit(g)) for g in (1, 2, 3)]
    spans = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.trim(F.concat(a, b)))
    return answers.select("answer_id", "book_id", F.posexplode(spans).alias("i", "quote")).where(F.length("quote") >= LEAST_QUOTE)


def checked(answers: DataFrame, evidence: DataFrame, pages: DataFrame, least: int = 1) -> DataFrame:
    """(answer_id, kind, page, excerpt): what in answers no page bears out.

    A page claim is unindexed where the page is neither evidence (answer_id, page) nor among the book's `pages` (book_id,
    page, text). A quote is not found where none of the pages claimed or in evidence has it in match form; where none
    of these has text, quotes aren't judged. Answers on books without any page have no findings. An answer meets its own
    pages only, by equal keys. Numbers below `least` are no claims; with 0, a page 0 that is named is one that isn't there.
    """
    indexed = pages.select("book_id").distinct()
    asked = answers.select("answer_id", "book_id", "body").join(indexed, "book_id", "left_semi")
    claims, shown = page_claims(asked, least), evidence.select("answer_id", F.col("page").cast("int").alias("page")).distinct()
    open_claims = claims.join(shown, ["answer_id", "page"], "left_anti").join(pages.select("book_id", "page"), ["book_id", "page"], "left_anti")
    unindexed = open_claims.select("answer_id", F.lit("page_claim_unindexed").alias("kind"), "page", F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页")).alias("excerpt"))
    named = claims.unionByName(shown.join(asked.select("answer_id", "book_id"), "answer_id")).distinct()
    texts = pages.select("book_id", "page", T.match_form(F.col("text")).alias("m")).where("m <> ''")
    quotes = answer_quotes(asked).select("answer_id", "i", "quote", T.match_form(F.col("quote")).alias("q")).where("q <> ''")
    # Quotes come to the page, some answers at a time, so that a text travels once and a page that all name is no one task.
    part = F.pmod(F.xxhash64("answer_id"), F.lit(PARTS)).alias("part")
    by_page = quotes.join(named.select("answer_id", "book_id", "page"), ["answer_id"]).groupBy("book_id", "page", part).agg(F.collect_list(F.struct("answer_id", "i", "quote", "q")).alias("asked"))
    beside = by_page.join(texts, ["book_id", "page"]).select("m", F.explode("asked").alias("a"))
    judged = beside.groupBy("a.answer_id", "a.i").agg(F.max(F.contains("m", "a.q")).alias("ok"), F.first("a.quote").alias("quote"))
    absent = judged.where("NOT ok").select("answer_id", F.lit("quote_not_found").alias("kind"), F.lit(None).cast("int").alias("page"), _excerpt("quote").alias("excerpt"))
    return unindexed.unionByName(absent)
