"""Outlines: flat rows (book_id, ord, depth, label, page) in pre-order, and what is inferred from headings and page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .headings import CHINESE_DIGITS, PHONETIC
from .trees import last_before, running

LEAST_ENTRIES, LEAST_RESOLVED, LEAST_RATIO, LEAST_VOTES = 3, 2, 0.5, 2
#: Ords of a book in one window.
BLOCK = 20_000
#: Fixed value: what titles of bookmarks without one begin with.
PLACEHOLDER = "未命名"


def title_key(label: Column) -> Column:
    """What a title is looked up by: without ordinals and phonetic notes, letters and digits only, at least two."""
    bare = F.regexp_replace(label, rf"^第[{CHINESE_DIGITS}\d]+(?:部|篇|章|节|组|单元)\s*", "")
    bare = F.regexp_replace(bare, r"(?i)^(?:part|chapter|appendix|unit|section)\s+(?:\d+|[ivxlcdm]+)\b\s*", "")
    bare = F.regexp_replace(bare, r"^[1-9]\d?\s*[.．]\s*[1-9]\d{0,2}(?![.\d])\s*", "")
    bare = F.regexp_replace(bare, r"^[1-9]\d?\s*\*?\s*[\s.．]?\s*", "")
    title = F.when(bare != "", bare).otherwise(label)
    key = F.regexp_replace(F.lower(F.regexp_replace(title, PHONETIC, "")), r"[^a-z0-9一-鿿]", "")
    return F.when(F.length(key) >= 2, key)


def body_size(lines: DataFrame) -> DataFrame:
    """(book_id, body): the median of the lowest three quarters of line sizes."""
    by_size = Window.partitionBy("book_id").orderBy("size")
    all_lines = Window.partitionBy("book_id")
    low = lines.withColumn("r", F.row_number().over(by_size)).withColumn("n", F.count("*").over(all_lines)).where(F.col("r") <= F.greatest(F.lit(1), F.floor(0.75 * F.col("n"))))
    return low.groupBy("book_id").agg(F.percentile("size", F.lit(0.5)).alias("body"))


def page_offset(votes: DataFrame) -> DataFrame:
    """(book_id, page_offset, basis): the plurality offset of anchors, else of body pages, else of contents pages.

    votes: (book_id, kind, offset), kind anchor, body or toc. A winner needs LEAST_VOTES in all of anchor and body (or
    toc); ties go to the greater total, then to the smaller offset.
    """
    counts = votes.groupBy("book_id", "offset").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("anchor", "body", "toc")])
    counts = counts.withColumn("sure", F.col("anchor") + F.col("body"))
    best = lambda k, total: F.max(F.when(F.col(k) > 0, F.struct(F.col(k).alias("k"), F.col(total).alias("total"), (-F.col("offset")).alias("o"))))
    per = counts.groupBy("book_id").agg(best("anchor", "sure").alias("a"), best("body", "sure").alias("b"), best("toc", "toc").alias("t"))
    won = lambda c: F.when(F.col(f"{c}.total") >= LEAST_VOTES, -F.col(f"{c}.o"))
    basis = F.when(won("a").isNotNull(), "anchor").when(won("b").isNotNull(), "body").when(won("t").isNotNull(), "toc")
    return per.select("book_id", F.coalesce(won("a"), won("b"), won("t")).alias("page_offset"), basis.alias("basis"))


def chapter_ranges(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(book_id, start, end): roots' distinct pages, each to the page before the next; the last to the end of the book."""
    starts = nodes.where("depth = 1 AND page IS NOT NULL").select("book_id", F.col("page").alias("start")).distinct()
    after = F.lead("start").over(Window.partitionBy("book_id").orderBy("start"))
    return starts.withColumn("after", after).join(totals, "book_id").select("book_id", "start", F.coalesce(F.col("after") - 1, F.col("total")).alias("end"))


def chapter_of(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """`pages` with the range they lie in: as of the greatest start that is not behind them, by a window, not a range join."""
    rows = pages.select("book_id", "page", F.lit(None).cast("int").alias("start"), F.lit(1).alias("is_page")).unionByName(ranges.select("book_id", F.col("start").alias("page"), F.col("start").cast("int"), F.lit(0).alias("is_page")))
    before = Window.partitionBy("book_id").orderBy("page", "is_page").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.last("start", ignorenulls=True).over(before)).where("is_page = 1").select("book_id", "page", "start")


def _following(rows: DataFrame, by: list[str], value: Column, own: bool) -> DataFrame:
    """`rows` with `next`: the first `value` that isn't null behind a row by `ord` among the rows of equal `by`. own: a row's own comes first.

    A value is a struct that begins with the row's ord. Each BLOCK of ords is a window of its own, then one over the
    blocks' first values, so a large book is many tasks' work.
    """
    rows = rows.withColumn("_block", F.floor(F.col("ord") / BLOCK)).withColumn("_value", value)
    back = lambda w, c, to: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, to))
    near = rows.withColumn("_near", back(Window.partitionBy(*by, "_block").orderBy(F.desc("ord")), "_value", 0 if own else -1))
    blocks = rows.groupBy(*by, "_block").agg(F.min("_value").alias("_first"))
    later = blocks.withColumn("_later", back(Window.partitionBy(*by).orderBy(F.desc("_block")), "_first", -1)).drop("_first")
    keys = [*by, "_block"]
    later = later.select("_later", *[F.col(k).alias(f"{k}_") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return near.join(later, same, "left").withColumn("next", F.coalesce("_near", "_later")).drop("_block", "_value", "_near", "_later", *[f"{k}_" for k in keys])


def _next_as_high(nodes: DataFrame, value: Column) -> DataFrame:
    """`nodes` with `next`: the value of the next node that is at least as high. A row counts at each of its book's depths from its own on."""
    depths = nodes.groupBy("book_id").agg(F.collect_set("depth").alias("_depths"))
    each = nodes.join(depths, "book_id").withColumn("_level", F.explode_outer(F.filter("_depths", lambda d: d >= F.col("depth")))).drop("_depths")
    return _following(each, ["book_id", "_level"], F.when(F.col("depth").isNotNull(), value), own=False).where(F.col("_level").eqNullSafe(F.col("depth"))).drop("_level")


def section_ranges(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(book_id, ord, start, end): a node's own or first paged descendant's page, to before the next node as high that has one."""
    nodes = nodes.select("book_id", "ord", "depth", "page")
    bound = _next_as_high(nodes, F.struct("ord")).withColumn("past", F.col("next.ord")).drop("next")
    paged = _following(bound, ["book_id"], F.when(F.col("page").isNotNull(), F.struct("ord", "page")), own=True)
    resolved = paged.where("next IS NOT NULL AND (past IS NULL OR next.ord < past)").select("book_id", "ord", "depth", F.col("next.page").alias("start"))
    ends = _next_as_high(resolved, F.struct("ord", "start")).withColumn("next", F.col("next.start"))
    return ends.join(totals, "book_id").select("book_id", "ord", "start", F.greatest(F.col("start"), F.coalesce(F.col("next") - 1, F.col("total"))).alias("end"))


def monotone(nodes: DataFrame) -> DataFrame:
    """Pages never fall in pre-order: each is at least the greatest before it."""
    running = F.max("page").over(Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return nodes.withColumn("page", F.when(F.col("page").isNotNull(), running))


def embedded_gate(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(book_id, accepted): whether a file's own bookmarks are worth using.

    Entries without a page in the book count as such only. Blank labels don't; labels that are all alike, all numbers or
    all placeholders don't serve, nor does a bookmark for each page of the book in turn.
    """
    before = Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    good = nodes.join(totals, "book_id").withColumn("ok", F.when(F.col("page").between(F.lit(1), F.col("total")), F.col("page")))
    good = good.withColumn("step", F.col("ok") - F.last("ok", ignorenulls=True).over(before))
    label = F.nullif(F.trim(F.coalesce("label", F.lit(""))), F.lit(""))
    per = good.groupBy("book_id", "total").agg(
        F.count("*").alias("n"), F.count("ok").alias("r"), F.count_distinct("ok").alias("pages"), F.count_distinct(label).alias("labels"),
        F.count_if(~label.rlike("^[0-9]+$")).alias("words"), F.count_if(~label.startswith(PLACEHOLDER)).alias("named"), F.count_if(F.col("step") != 1).alias("jumps"))
    every_page = (F.col("r") >= F.greatest(F.lit(3), F.col("total"))) & (F.col("jumps") == 0)
    enough = (F.col("n") >= LEAST_ENTRIES) & (F.col("r") >= LEAST_RESOLVED) & (F.col("r") / F.col("n") >= LEAST_RATIO) & (F.col("pages") >= 2)
    return per.select("book_id", (enough & (F.col("labels") > 1) & (F.col("words") > 0) & (F.col("named") > 0) & ~every_page).alias("accepted"))


def toc_candidates(pages: DataFrame) -> DataFrame:
    """(book_id, page): pages with an index block and their neighbours, from page 1."""
    around = pages.where("has_index").select("book_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - 1), F.col("page") + 1)).alias("page"))
    return around.distinct()


def inherited_pages(rows: DataFrame) -> DataFrame:
    """Rows without a page take one from a neighbour that has its own: level 1 looks forward first, others back first.

    Backwards is forwards by the negated ord, so either way is one pass: a frame that ends at a book's last row is read anew
    for each row.
    """
    own = lambda ord: F.when(F.col("page").isNotNull(), F.struct(F.col(ord), "page"))
    ahead = _following(rows, ["book_id"], own("ord"), own=True).withColumnsRenamed({"next": "_ahead", "ord": "_ord"})
    both = _following(ahead.withColumn("ord", -F.col("_ord")), ["book_id"], own("ord"), own=True)
    ahead, back = F.col("_ahead.page"), F.col("next.page")
    found = both.withColumn("page", F.when(F.col("level") == 1, F.coalesce("page", ahead, back)).otherwise(F.coalesce("page", back, ahead)))
    return found.withColumn("ord", F.col("_ord")).select(*rows.columns)


def level_tree(rows: DataFrame) -> DataFrame:
    """(book_id, ord, label, level, parent, depth) of rows (book_id, ord, label, level), as a stack in order of ord nests them.

    A row is one deeper than the row before it, or at its own level where that is less; so its depth is a running minimum,
    and its parent the last row one less deep.
    """
    rows = rows.select("book_id", F.col("ord").cast("long").alias("ord"), "label", F.col("level").cast("int").alias("level"))
    numbered = running(rows, "_n", F.lit(1))
    reached = running(numbered, "_m", F.greatest(F.lit(1), F.coalesce("level", F.lit(1))) - F.col("_n"), F.min)
    placed = written(reached.withColumn("depth", (F.col("_n") + F.least(F.lit(0), F.col("_m"))).cast("int")).drop("_n", "_m"))
    return last_before(placed, "_d", F.array("depth"), F.col("depth") - 1, "parent").select("book_id", "ord", "label", "level", "parent", "depth")
