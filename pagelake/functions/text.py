"""Text expressions: columns in, columns out, all inside Spark's own functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the search rules.
CJK = r"[　-鿿＀-￯]"
TERM_BREAKS = r"[\s,，、;；:：/|]+"
DOT_LEADERS = r"[.．·・…‥]{3,}"
MAX_TERMS, FULL_LENGTH, LENGTH_FLOOR = 8, 120, 0.4
#: What a heading begins with, and the most characters it has.
HEADING_WORDS = r"第[一二三四五六七八九十百零〇0-9]+[章节篇部]|chapter\s+\w+"
HEADING_NUMBER, HEADING_CHARS = r"\d+(?:\.\d+){0,3}\s+\S", 80
#: Entities by name.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "-", "mdash": "--", "hellip": "...", "amp": "&"}
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_MISS = 60, 100, 160


def collapsed(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def index_tokens(text: Column) -> Column:
    """CJK characters stand alone, other words stay whole."""
    return collapsed(F.regexp_replace(text, f"({CJK})", " $1 "))


def _bare_letters() -> tuple[str, str]:
    """Letters with marks of the Latin, Greek and Cyrillic scripts, and the letters without; marks by themselves come last, without any."""
    bases = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            bases[chr(code)] = parts[0]
    return "".join(bases) + "".join(map(chr, range(0x300, 0x370))), "".join(bases.values())


MARKED, BARE = _bare_letters()


def without_marks(text: Column) -> Column:
    """Accents and other marks go from letters."""
    return F.translate(text, MARKED, BARE)


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased and without marks; a CJK character is a word."""
    return F.regexp_extract_all(without_marks(F.lower(index_tokens(text))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def search_terms(query: Column, most: int = MAX_TERMS) -> Column:
    """The first distinct terms of a query."""
    return F.slice(F.array_distinct(F.filter(F.split(query, TERM_BREAKS), lambda t: t != "")), 1, most)


def length_factor(text: Column) -> Column:
    """How far a text's vector is trusted: 1 from FULL_LENGTH characters, of which dot leaders take three each."""
    runs = F.regexp_extract_all(text, F.lit(f"({DOT_LEADERS})"), F.lit(1))
    dots = F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r))
    size = F.greatest(F.lit(0), F.length(text) - 3 * dots)
    return F.when(size >= FULL_LENGTH, 1.0).otherwise(F.greatest(F.lit(LENGTH_FLOOR), size / FULL_LENGTH))


def snippet(text: Column, query: Column) -> Column:
    """The surroundings of the whole query in a text, or the text's beginning."""
    at = F.instr(F.lower(text), F.lower(query))
    start, end = F.greatest(F.lit(0), at - 1 - SNIPPET_BEFORE), F.least(F.length(text), at - 1 + F.length(query) + SNIPPET_AFTER)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.left(text, F.lit(SNIPPET_MISS)))


def page_text(text: Column) -> Column:
    """Line ends are \\n, no white space beside them, no more than one blank line, none at the ends."""
    x = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[^\S\n]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def match_form(text: Column) -> Column:
    """For quotes: without white space, punctuation and symbols, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[\s\p{P}\p{S}]+", ""))


def token_estimate(text: Column, chars_a_token: int = 4) -> Column:
    """CJK characters are a token each, others `chars_a_token` to one."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    return F.ceil((chars_a_token * cjk + F.length(text) - cjk) / F.lit(chars_a_token)).cast("long")


def bounded_fact(text: Column, most: int) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), r"\s+", " ")), F.lit(most))


def export_name(title: Column, day: Column, label: str = "conversation", fallback: str = "untitled", most: int = 80) -> Column:
    """A conversation's file name: its title without reserved characters and without dots or blanks at the end, and the day."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r'[<>:"/\\|?*\x00-\x1f]', ""))
    cut = F.regexp_replace(F.left(F.regexp_replace(bare, "[. ]+$", ""), F.lit(most)), "[. ]+$", "")
    return F.concat(F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback)), F.lit(f"-{label}-"), F.date_format(day, "yyyyMMdd"), F.lit(".md"))


#: What begins and ends a block of code in Markdown, and a formula of its own.
FENCE, DISPLAY = r"^ {0,3}(`{3,}|~{3,})(.*)$", "$$"


def settled_length(text: Column) -> Column:
    """How many characters of a text that is still being written are settled Markdown: up to behind the last blank line that
    is in no block of code and behind no open formula. 0 where there is none; null for null.

    One pass over the lines: whether a block is open, by what sign and how long, formulas' marks so far, characters so far.
    A line counts with its line feed; a blank line is where two line feeds follow one another.
    """
    lines = F.split(text, "\n", -1)
    mark = lambda line: F.regexp_extract(line, FENCE, 1)
    rest = lambda line: F.regexp_extract(line, FENCE, 2)

    def step(a: Column, line: Column) -> Column:
        fence = mark(line)
        opens = (a["mark"] == "") & (fence != "") & ~((F.left(fence, F.lit(1)) == "`") & F.contains(rest(line), F.lit("`")))
        closes = (a["mark"] != "") & (F.left(fence, F.lit(1)) == F.left(a["mark"], F.lit(1))) & (F.length(fence) >= F.length(a["mark"])) & F.trim(rest(line)).isin("", "\r")
        held = F.when(opens, fence).when(closes, "").otherwise(a["mark"])
        marks = a["marks"] + F.size(F.split(line, r"\$\$", -1)) - 1
        at = a["at"] + F.length(line) + 1
        # This line is empty and follows another: its line feed is the second of two.
        settled = F.when((line == "") & (a["at"] > 0) & (a["mark"] == "") & (marks % 2 == 0), at).otherwise(a["settled"])
        return F.struct(held.alias("mark"), marks.alias("marks"), at.alias("at"), settled.alias("settled"))

    start = F.struct(F.lit("").alias("mark"), F.lit(0).alias("marks"), F.lit(0).alias("at"), F.lit(0).alias("settled"))
    # The last line has no line feed behind it, so it settles nothing.
    return F.when(text.isNotNull(), F.aggregate(F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1)), start, step, lambda a: a["settled"]))


def stripped_html(html: Column) -> Column:
    """Bold marks vanish, other tags are a space, white space is collapsed."""
    return collapsed(F.regexp_replace(F.regexp_replace(html, r"(?i)</?b\b[^>]*>", ""), r"<[^>]+>", " "))


def decoded_entities(text: Column) -> Column:
    """Entities by name or number as their characters, each read once; numbers that are no character stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?is)(&(?:" + "|".join(ENTITIES) + r"|#\d+|#x[0-9a-f]+);|&|[^&]+)"), F.lit(1))
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, "^&([^;]+);$", 1))
        digits = F.when(F.left(name, F.lit(2)) == "#x", F.conv(F.substring(name, 3, 100), 16, 10)).otherwise(F.substring(name, 2, 100))
        code = digits.try_cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # A code point as four bytes of UTF-32.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(name == "", part).when(F.left(name, F.lit(1)) == "#", F.when(valid, char).otherwise(part)).otherwise(F.coalesce(named[name], part))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def escaped_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def looks_like_heading(line: Column) -> Column:
    """At most HEADING_CHARS characters that begin with a chapter word or a dotted number."""
    bare = F.trim(line)
    return (F.length(bare) <= HEADING_CHARS) & bare.rlike(f"^(?i:{HEADING_WORDS}|{HEADING_NUMBER})")


def roman_numeral(text: Column) -> Column:
    """The value of a Roman numeral, null if it is none: a smaller sign before a greater one is subtracted."""
    value = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    signs = F.split(F.upper(text), "")
    step = lambda a, s: F.struct((a["sum"] + value[s] - F.when(a["last"] < value[s], 2 * a["last"]).otherwise(0)).alias("sum"), value[s].alias("last"))
    total = F.aggregate(F.filter(signs, lambda s: s != ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda a: a["sum"])
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), total)


def chinese_numeral(text: Column) -> Column:
    """The value of a Chinese numeral below 1000, null if it is none or zero."""
    digit = F.create_map(*[F.lit(x) for i, d in enumerate("零一二三四五六七八九") for x in (d, i)], F.lit("〇"), F.lit(0), F.lit("两"), F.lit(2))

    def step(a: Column, s: Column) -> Column:
        unit = F.when(s == "百", 100).when(s == "十", 10)
        return F.when(unit.isNotNull(), F.struct((a["sum"] + F.when(a["last"] == 0, 1).otherwise(a["last"]) * unit).alias("sum"), F.lit(0).alias("last"))).otherwise(F.struct(a["sum"].alias("sum"), digit[s].alias("last")))

    total = F.aggregate(F.filter(F.split(text, ""), lambda s: s != ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda a: a["sum"] + a["last"])
    return F.when(text.rlike("^[零〇一二两三四五六七八九十百]+$") & (total > 0), total)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two float arrays in double precision, within [0, 1]; 0 for different lengths or a zero vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(left, left) * dot(right, right))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(left, right) / norm))
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0) & (norm > 0), value).otherwise(0.0)
