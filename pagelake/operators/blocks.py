"""Typed blocks of recognised pages: parsed, figures numbered, assembled into page text, headings and printed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed

#: The heading types, the figure line, and lines that are page numbers.
HEADING_TYPES = ("title", "paragraph_title", "doc_title")
FIGURE_LINE = r"^\[插图 \d+·约占页面 \d+%：内容不可见，可用 view_page 查看第 \d+ 页插图 \d+\]$"
PAGE_NUMBER_LINE = r"(?i)^(?:第?\s*\d+\s*页|page\s+\d+(?:\s+of\s+\d+)?|\d+)$"
BLOCK = "struct<type: string, text: string, bbox: array<double>>"
#: Letters of native text that make a page's own text enough.
NATIVE_LEAST = 16


def parsed_blocks(reply: Column) -> Column:
    """The blocks of a parser's JSON reply; those without a type or with other than four coordinates are dropped."""
    blocks = F.coalesce(F.from_json(reply, f"array<{BLOCK}>"), F.expr(f"cast(array() AS array<{BLOCK}>)"))
    return F.filter(blocks, lambda b: b["type"].isNotNull() & ((b["bbox"].isNull()) | (F.size(b["bbox"]) == 4)))


def is_figure(block: Column) -> Column:
    """An image block whose box has four finite coordinates and an area."""
    box = block["bbox"]
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((block["type"] == "image") & finite & (box[2] > box[0]) & (box[3] > box[1]), F.lit(False))


def figure_blocks(blocks: Column) -> Column:
    return F.filter(blocks, is_figure)


def figure_line(page: Column, figure: Column, box: Column) -> Column:
    """What stands for a figure in a page's text: its number and its share of the page in per cent, 1 to 100."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), b - a))
    percent = F.greatest(F.lit(1), F.least(F.lit(100), F.floor(side(box[0], box[2]) * side(box[1], box[3]) * 100 + 0.5).cast("int")))
    return F.format_string("[插图 %d·约占页面 %d%%：内容不可见，可用 view_page 查看第 %d 页插图 %d]", figure, percent, page, figure)


def without_figure_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(FIGURE_LINE)), "\n")


def assembled(pages: DataFrame) -> DataFrame:
    """(book_id, page, text, indexable, figures) of pages (book_id, page, blocks): figures by their line, the rest by its text.

    A figure's number is its place among the page's figures; blocks without text leave no line.
    """
    at = F.filter(F.transform("blocks", lambda b, i: F.when(is_figure(b), i).otherwise(-1)), lambda i: i >= 0)
    placed = pages.withColumn("_at", at)
    lines = F.transform("blocks", lambda b, i: F.when(F.array_contains("_at", i), figure_line(F.col("page"), F.array_position("_at", i), b["bbox"])).otherwise(F.coalesce(b["text"], F.lit(""))))
    joined = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    text = F.regexp_replace(F.regexp_replace(joined, r"[\s&&[^\n]]+", " "), r"^\s+|\s+$", "")
    done = placed.withColumn("text", text)
    return done.select("book_id", "page", "text", without_figure_lines(F.col("text")).alias("indexable"), F.size("_at").alias("figures"))


def recognised_headings(pages: DataFrame, level: Column, known: Column) -> DataFrame:
    """(book_id, page, at, label, level, top) of the heading blocks of pages (book_id, page, height, blocks).

    level, known: over `label`, its explicit level or null, and whether it is a known part of a book. A block's top edge
    counts from the bottom of the page; without the page's height it is unknown.
    """
    each = pages.select("book_id", "page", "height", F.posexplode("blocks").alias("at", "b")).where(F.col("b.type").isin(*HEADING_TYPES) & F.col("b.text").isNotNull())
    each = each.withColumn("label", collapsed(F.col("b.text"))).where("length(label) BETWEEN 2 AND 100")
    top = F.when(F.col("height") > 0, (1 - F.col("b.bbox")[1]) * F.col("height"))
    return each.select("book_id", "page", "at", "label", F.coalesce(level, F.when(known, 1).otherwise(3)).alias("level"), top.alias("top"))


def page_text_source(native: Column, recognised: Column) -> Column:
    """'native', 'ocr' or 'empty': a page's own lines if they hold enough beside page numbers, or nothing was recognised."""
    length = F.aggregate(F.filter(F.transform(native, collapsed), lambda x: ~x.rlike(PAGE_NUMBER_LINE)), F.lit(0), lambda a, x: a + F.length(x))
    chosen = (length >= NATIVE_LEAST) | (F.size(recognised) <= 0)
    return F.when(chosen, F.when(F.size(native) > 0, "native").otherwise("empty")).otherwise("ocr")


def native_length(native: Column) -> Column:
    """Characters of lines that are no page numbers."""
    return F.aggregate(F.filter(F.transform(native, collapsed), lambda x: ~x.rlike(PAGE_NUMBER_LINE)), F.lit(0), lambda a, x: a + F.length(x))


def printed_numbers(source: Column, native: Column, blocks: Column) -> Column:
    """Page numbers that a page prints: of recognised pages the number blocks', of others lines of one to four digits."""
    own = F.transform(F.filter(F.transform(native, collapsed), lambda x: x.rlike(r"^\d{1,4}$")), lambda x: x.cast("int"))
    number = F.transform(F.filter(blocks, lambda b: b["type"] == "page_number"), lambda b: F.regexp_extract(F.coalesce(b["text"], F.lit("")), r"\d{1,4}", 0))
    read = F.transform(F.filter(number, lambda x: x != ""), lambda x: x.cast("int"))
    return F.when(source == "native", own).when(source == "ocr", read).otherwise(F.expr("cast(array() AS array<int>)"))


def has_index(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: b["type"] == "index")


def native_lines(fragments: DataFrame, apart: float = 2.0, gap: float = 0.45) -> DataFrame:
    """(page, line, text, size) of fragments (page, x, y, width, size, text): those within `apart` of a line's first one, top down.

    A page's fragments, some hundreds, are one group: which line takes one depends on the lines before it.
    """
    import pandas as pd

    def grouped(rows: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []
        for r in rows[rows["text"].str.strip() != ""].sort_values(["y", "x"], ascending=[False, True], kind="stable").itertuples():
            line = next((k for k in lines if abs(k[0].y - r.y) <= apart), None)
            lines.append([r]) if line is None else line.append(r)
        out = []
        for i, line in enumerate(lines):
            text, end = "", None
            for r in sorted(line, key=lambda r: r.x):
                text += (" " if end is not None and r.x - end > r.size * gap else "") + r.text
                end = r.x + r.width
            out.append((rows["page"].iloc[0], i, text, max(r.size for r in line)))
        return pd.DataFrame(out, columns=["page", "line", "text", "size"])

    return fragments.groupBy("page").applyInPandas(grouped, "page long, line int, text string, size double")
