"""Headings: what their labels say, which lines look like one, and the outlines that headings alone make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, chinese_numeral, collapsed, roman_numeral
from ..sources.shared import written
from .trees import last_before, lineages

#: The words of chapters and sections, and of parts of a book that carry no number.
CHINESE_DIGITS = "一二三四五六七八九十百零〇两"
CHINESE = rf"^第\s*([{CHINESE_DIGITS}\d]+)\s*(部|篇|章|节|组|单元)"
ENGLISH = r"(?i)^(part|chapter|appendix|unit|section)\s+(\d+|[ivxlcdm]+)\b"
NUMBERED = r"^([1-9]\d?)\s*[.．]\s*([1-9]\d{0,2})(?![.\d])"
KNOWN_PARTS = r"^(附录|参考文献|索引|习题)"
PAGE_LINE, LEADERS = r"(?i)^(?:第?\s*\d+\s*页|page\s+\d+(?:\s+of\s+\d+)?)$", r"\.{3,}\s*\d+$"
PHONETIC = r"\([a-zāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü]{1,8}\)"
RATIOS = (1.7, 1.42, 1.32)
LEAST_ROOTS, REPEATED_PAGES = 3, 3


def ordinal(label: Column) -> Column:
    """struct<type, number, scope>: 'chapter' or 'section' and its number; a dotted section's chapter is its scope. Null for other labels."""
    chinese = F.regexp_extract(label, CHINESE, 1)
    chinese_number = F.when(chinese.rlike(r"^\d+$"), chinese.cast("int")).otherwise(chinese_numeral(chinese))
    english = F.regexp_extract(label, ENGLISH, 2)
    english_number = F.when(english.rlike(r"^\d+$"), english.cast("int")).otherwise(roman_numeral(english))
    made = lambda kind, number, scope: F.struct(kind.alias("type"), number.cast("int").alias("number"), scope.cast("int").alias("scope"))
    none = F.lit(None)
    kind = lambda section: F.when(section, F.lit("section")).otherwise(F.lit("chapter"))
    return (
        F.when((chinese != "") & (chinese_number > 0), made(kind(F.regexp_extract(label, CHINESE, 2) == "节"), chinese_number, none))
        .when((english != "") & (english_number > 0), made(kind(F.lower(F.regexp_extract(label, ENGLISH, 1)) == "section"), english_number, none))
        .when(label.rlike(NUMBERED), made(F.lit("section"), F.regexp_extract(label, NUMBERED, 2), F.regexp_extract(label, NUMBERED, 1)))
    )


def explicit_level(label: Column) -> Column:
    """1 for chapters and the like, 2 for sections, the number of segments (3 at most) for dotted numbers; else null."""
    chinese = F.regexp_extract(label, rf"^第[{CHINESE_DIGITS}\d]+(部|篇|章|节|组|单元)", 1)
    dotted = F.regexp_extract(label, r"^(\d+(?:\.\d+){0,3})(?=[\s、.．]+\S)", 1)
    segments = F.size(F.split(dotted, r"\."))
    return (
        F.when(label.rlike(r"(?i)^(?:part|chapter|appendix|unit)\s+(?:\d+|[ivxlcdm]+|[a-z])\b"), 1)
        .when(label.rlike(r"(?i)^section\s+(?:\d+|[ivxlcdm]+|[a-z])\b"), 2)
        .when(chinese != "", F.when(chinese == "节", 2).otherwise(1))
        .when((dotted != "") & (segments >= 2), F.least(F.lit(3), segments))
    )


def admitted(label: Column) -> Column:
    """Whether a heading may stand in an outline by itself."""
    return explicit_level(label).isNotNull() | label.rlike(KNOWN_PARTS)


def keyed(headings: DataFrame) -> DataFrame:
    """`headings` (book_id, ord, label, ...) with `key`: 'c7', or 's2.3' where a section without scope takes that of the last chapter, 0 before any."""
    rows = headings.withColumn("_o", ordinal(F.col("label")))
    order = Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_o.type") == "chapter", F.col("_o.number")), ignorenulls=True).over(order)
    scope = F.coalesce("_o.scope", last, F.lit(0))
    key = F.when(F.col("_o.type") == "chapter", F.concat(F.lit("c"), "_o.number")).when(F.col("_o").isNotNull(), F.concat(F.lit("s"), scope, F.lit("."), "_o.number"))
    return rows.withColumn("key", key)


def first_of_each(headings: DataFrame) -> DataFrame:
    """`keyed` headings without running heads: the first of each key, and of each label that REPEATED_PAGES pages or more show."""
    label = F.lower("label")
    pages = headings.groupBy("book_id", label.alias("_l")).agg(F.count_distinct("page").alias("_pages")).withColumnRenamed("book_id", "_b")
    rows = keyed(headings).join(pages, (F.col("book_id") == F.col("_b")) & (label == F.col("_l")))
    by = F.coalesce("key", F.when(F.col("_pages") >= REPEATED_PAGES, F.concat(F.lit("l"), "_l")), F.concat(F.lit("o"), F.col("ord").cast("string")))
    first = Window.partitionBy("book_id", "_by").orderBy("ord")
    return rows.withColumn("_by", by).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*headings.columns, "key")


def sized(lines: DataFrame) -> DataFrame:
    """(page_id, ord, label, _level, _shaped): lines (page_id, ord, text, size) that may be headings, their level by size, and whether size and letters make them one.

    Body size is the median of the lowest three quarters of the sizes of long lines, of all lines where fewer than three
    are long. Size makes a heading by its ratio to that, with no sentence end and enough letters or a phonetic note.
    """
    rows = lines.withColumn("label", collapsed(F.col("text"))).where("label <> '' AND size > 0").select("page_id", "ord", "label", "size")
    cjk = F.length("label") - F.length(F.regexp_replace("label", CJK, ""))
    rows = rows.withColumn("_cjk", cjk).withColumn("_long", (cjk >= 4) | F.col("label").rlike("[A-Za-z]{6,}"))
    page = Window.partitionBy("page_id")
    rows = rows.withColumn("_of", F.when(F.count_if("_long").over(page) >= 3, F.col("_long")).otherwise(F.lit(True)))
    rows = rows.withColumn("_n", F.count_if("_of").over(page)).withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "_of").orderBy("size", "ord")))
    low = F.when(F.col("_of") & (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.75))), F.col("size"))
    rows = rows.withColumn("_body", F.percentile(low, F.lit(0.5)).over(page)).withColumn("_body", F.when(F.col("_body") > 0, F.col("_body")).otherwise(1.0))
    ratio, latin = F.col("size") / F.col("_body"), F.length(F.regexp_replace("label", "[^A-Za-z]", ""))
    plain = F.col("label").rlike(PAGE_LINE) | F.col("label").rlike(r"^\d+$") | F.col("label").rlike(LEADERS)
    shaped = (ratio >= RATIOS[2]) & ~F.col("label").rlike(r"[。！？!?；;:]$") & ((F.col("_cjk") >= 4) | (latin >= 6) | F.col("label").rlike(PHONETIC))
    level = F.when(ratio >= RATIOS[0], 1).when(ratio >= RATIOS[1], 2).otherwise(3)
    return rows.where(F.length("label").between(2, 100) & ~plain).select("page_id", "ord", "label", level.alias("_level"), shaped.alias("_shaped"))


def by_size(lines: DataFrame) -> DataFrame:
    """(page_id, ord, label, level): lines (page_id, ord, text, size) that size makes headings, numbered or not."""
    return sized(lines).where("_shaped").select("page_id", "ord", "label", F.col("_level").alias("level"))


def candidates(lines: DataFrame) -> DataFrame:
    """(page_id, ord, label, level, explicit): lines (page_id, ord, text, size) that look like headings, by their number or by size."""
    rows, level = sized(lines), explicit_level(F.col("label"))
    return rows.where(level.isNotNull() | F.col("_shaped")).select("page_id", "ord", "label", F.coalesce(level, F.col("_level")).alias("level"), level.isNotNull().alias("explicit"))


def body_outline(headings: DataFrame) -> DataFrame:
    """(book_id, ord, label, page, level): the outline that a book's admitted headings make, nothing where they make none.

    Roots are headings that no shallower one precedes. There must be three, three of them numbered, and their numbers rise.
    """
    kept = first_of_each(headings).where(admitted(F.col("label"))).withColumn("level", F.coalesce(explicit_level(F.col("label")), F.lit(1)))
    before = Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # The root of a forest by levels: no earlier heading is shallower.
    kept = kept.withColumn("_root", F.coalesce(F.min("level").over(before) >= F.col("level"), F.lit(True))).withColumn("_o", ordinal(F.col("label")))
    number = F.when(F.col("_o.type") == "section", F.coalesce("_o.scope", F.lit(0)) * 1000 + F.col("_o.number")).otherwise(F.col("_o.number"))
    spine = kept.where("_root").withColumn("_n", number)
    numbered = spine.where("_n IS NOT NULL").withColumn("_step", F.col("_n") - F.lag("_n").over(Window.partitionBy("book_id").orderBy("ord")))
    rising = numbered.groupBy("book_id").agg(F.count("*").alias("spine"), F.min("_step").alias("least"))
    good = spine.groupBy("book_id").agg(F.count("*").alias("roots")).join(rising, "book_id").where(f"roots >= {LEAST_ROOTS} AND spine >= {LEAST_ROOTS} AND least > 0").select("book_id")
    return kept.join(good, "book_id", "left_semi").select("book_id", "ord", "label", "page", "level")


def toc_entries(rows: DataFrame, anchors: DataFrame, offsets: DataFrame) -> DataFrame:
    """(book_id, ord, label, level, page) of rows of a printed contents (book_id, ord, label, level, printed), before missing pages are inherited.

    A row's page is that of its heading in the text, `anchors` (book_id, key, title_key, page), by its number first, then by its title; else its
    printed page and the book's offset (book_id, page_offset, total). Of rows alike in level and label the first stays.
    Known pages out of the book drop their rows; a null page is left to inherit.
    """
    from .outline import title_key

    first = Window.partitionBy("book_id", "level", F.lower("label")).orderBy("ord")
    rows = keyed(rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")).withColumn("_t", title_key(F.col("label")))
    by = lambda column, name: anchors.where(F.col(column).isNotNull()).groupBy(F.col("book_id").alias(f"{name}b"), F.col(column).alias(f"{name}k")).agg(F.min("page").alias(f"{name}p"))
    met = rows.join(by("key", "_x"), (F.col("book_id") == F.col("_xb")) & (F.col("key") == F.col("_xk")), "left")
    met = met.join(by("title_key", "_y"), (F.col("book_id") == F.col("_yb")) & (F.col("_t") == F.col("_yk")), "left").join(offsets, "book_id")
    anchor = F.coalesce("_xp", "_yp")
    page = F.when(anchor.between(F.lit(1), F.col("total")), anchor).otherwise(F.col("printed") + F.col("page_offset"))
    return met.select("book_id", "ord", "label", "level", page.alias("page"), "total").where("page IS NULL OR page BETWEEN 1 AND total").drop("total")


def paths(nodes: DataFrame) -> DataFrame:
    """`nodes` (book_id, ord, depth, label, page) with `path`: the labels from the root down to the node, however deep.

    A node lies under the last earlier one that is less deep; one that gives its ord at each depth below its own is found so.
    """
    depths = nodes.groupBy(F.col("book_id").alias("_b")).agg(F.collect_set("depth").alias("_depths"))
    rows = nodes.join(depths, F.col("book_id").eqNullSafe(F.col("_b"))).drop("_b").withColumn("ord", F.col("ord").cast("long"))
    under = written(last_before(rows, "_d", F.filter("_depths", lambda d: d > F.col("depth")), F.col("depth"), "_parent").drop("_depths"))
    return lineages(under, "ord", "_parent", F.col("label")).withColumn("path", F.array_compact("lineage")).select(*nodes.columns, "path")


def section_paths(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(book_id, page, path): of each page (book_id, page) the path of the last section that has begun; of those that begin
    on one page the deepest, then the first. Null before the first."""
    rank = F.struct("page", F.size("path").alias("deep"), (-F.col("ord")).alias("o"))
    best = paths(nodes).where("page IS NOT NULL").groupBy("book_id", "page").agg(F.max_by("path", rank).alias("path"))
    events = best.select("book_id", "page", "path", F.lit(0).alias("k")).union(pages.select("book_id", "page", F.lit(None).cast("array<string>"), F.lit(1)))
    upto = Window.partitionBy("book_id").orderBy("page", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("path", F.last("path", ignorenulls=True).over(upto)).where("k = 1").select("book_id", "page", F.array_join("path", " › ").alias("path"))


def active_nodes(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(book_id, page, ord): of each page the node in view: of those that begin at or before it the latest, the last in order on ties."""
    best = nodes.where("page IS NOT NULL").groupBy("book_id", "page").agg(F.max("ord").alias("ord"))
    events = best.select("book_id", "page", "ord", F.lit(0).alias("k")).union(pages.select("book_id", "page", F.lit(None).cast("long"), F.lit(1)))
    upto = Window.partitionBy("book_id").orderBy("page", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("ord", F.last("ord", ignorenulls=True).over(upto)).where("k = 1").select("book_id", "page", "ord")


def rendered(nodes: DataFrame) -> DataFrame:
    """(book_id, n_nodes, text): an outline as lines, two blanks a depth, with pages where known."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.col("label"), F.coalesce(F.concat(F.lit(" ("), F.col("page").cast("string"), F.lit(")")), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return nodes.groupBy("book_id").agg(F.count("*").alias("n_nodes"), F.array_join(lines, "\n").alias("text"))


def bookmark_tree(rows: DataFrame) -> DataFrame:
    """(book_id, node_id, depth, label, page, top) of bookmarks (book_id, id, parent, place, title, dest, kind, top).

    A node's id is the path of places from the root; a blank title is numbered; a page counts from 1; only exact
    destinations keep their top. Bookmarks of any depth are there, but for those under none that is.
    """
    label = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", collapsed(F.col("title"))).otherwise(F.concat(F.lit("未命名目录 "), F.col("place").cast("string")))
    found = lineages(rows, "id", "parent", F.col("place").cast("string"))
    return found.select("book_id", F.array_join("lineage", "-").alias("node_id"), F.size("lineage").alias("depth"), label.alias("label"), (F.col("dest") + 1).alias("page"), F.when(F.col("kind") == "XYZ", F.col("top")).alias("top"))


def tiers(books: DataFrame) -> DataFrame:
    """`books` with arm, strategy, status and calibrated: what a rebuild of each book's outline comes to.

    books: (book_id, total, accepted, native_majority, blocks, processed, toc_rows, page_offset, body_roots): pages, whether
    the file's bookmarks serve, whether most pages of the window have text of their own, pages that were recognised, pages
    whose headings are known, rows of the contents, where its numbers lie (null if unknown), roots of the outline of
    headings. Bookmarks that serve end it. Else contents are taken where their offset is known, headings only if the whole
    book can be judged; what can't be decided yet is partial, with a null strategy. Null facts count as unknown or none.
    """
    none = lambda c: F.coalesce(c, F.lit(0))
    own, total = F.coalesce("native_majority", F.lit(False)), none("total")
    arm = F.when(own, "native-majority").when((total > 0) & (none("blocks") >= total), "all-blocks").when(none("toc_rows") > 0, "calibrated").otherwise("wait")
    rows = books.withColumn("arm", F.when(~F.coalesce("accepted", F.lit(False)), arm))
    whole = F.col("arm").isin("native-majority", "all-blocks")
    contents = (none("toc_rows") > 0) & F.col("page_offset").isNotNull()
    ready = (F.col("arm") != "wait") & (none("processed") >= total)
    generated = F.when(contents, "ai_toc").when(whole, F.when(none("body_roots") > 0, "body_headings").otherwise("empty"))
    rows = rows.withColumn("strategy", F.when(F.col("arm").isNull(), "embedded").when(ready, generated))
    status = F.when(F.col("arm").isNull(), "embedded").when(F.col("strategy").isNull(), "partial").otherwise("generated")
    return rows.select("*", status.alias("status"), F.when(F.col("strategy").isNotNull(), F.col("arm").isNull() | whole).alias("calibrated"))


def rebuilt(decided: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that each book is left with. nodes: (book_id, strategy, …) of every tier; partial and empty ones have none."""
    return nodes.join(decided.select("book_id", "strategy"), ["book_id", "strategy"], "left_semi")


def read_tier(books: DataFrame) -> DataFrame:
    """`books` (cached, cached_entries, adjudicated, candidate_pages, accepted) with `on_read`: what a reader is shown.

    The stored outline; nothing where the rebuild is past bookmarks; else bookmarks if they serve, or nothing from then on.
    """
    past = F.coalesce("cached_entries", F.lit(False)) | F.coalesce("adjudicated", F.lit(False)) | (F.coalesce("candidate_pages", F.lit(0)) > 0)
    shown = F.when(F.coalesce("cached", F.lit(False)), "stored").when(past, "none").when(F.coalesce("accepted", F.lit(False)), "embedded")
    return books.withColumn("on_read", shown.otherwise("adjudicated"))
