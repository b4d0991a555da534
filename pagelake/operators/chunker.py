"""Overlapping chunks of page texts, cut at headings, paragraphs, lines or sentences."""

from __future__ import annotations

from collections.abc import Iterator
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The least and most tokens of a chunk, what two share, and the rules' version.
LEAST, MOST, OVERLAP, VERSION = 500, 800, 96, "v2"
#: Sentences end at these signs, and at a full stop before white space.
SENTENCE_ENDS = "。！？!?；;"
BLANKS = "\t\n\x0b\x0c\r \xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
_CJK = re.compile(T.CJK)
_HEADING = re.compile(rf"^[^\S\n]*(?:{T.HEADING_WORDS}|{T.HEADING_NUMBER})", re.I | re.M | re.A)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, _codes(chars))


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, their priorities), in order: a heading's start 5, a blank line 4, a heading's end 3, a line's end 2, a sentence's end 1."""
    codes = _codes(text)
    feeds = np.flatnonzero(codes == 10)
    starts, ends = np.concatenate(([0], feeds + 1)), np.concatenate((feeds, [len(codes)]))
    heads = np.array([m.start() for m in _HEADING.finditer(text)], dtype=np.int64)
    of = np.searchsorted(starts, heads, side="right") - 1
    short = np.array([len(text[starts[i] : ends[i]].strip()) <= T.HEADING_CHARS for i in of], dtype=bool)
    heading = np.zeros(len(starts), dtype=bool)
    heading[of[short]] = True
    priority = np.zeros(len(codes) + 1, dtype=np.int8)

    def put(places: np.ndarray, value: int) -> None:
        priority[places] = np.maximum(priority[places], value)

    stop = (codes == 46) & np.concatenate((_among(codes[1:], BLANKS), [True]))[: len(codes)]
    put(np.flatnonzero(_among(codes, SENTENCE_ENDS) | stop) + 1, 1)
    filled = ends > starts
    put(ends[filled & ~heading], 2)
    put(ends[filled & heading], 3)
    put(feeds[:-1][np.diff(feeds) == 1], 4)
    put(starts[heading & (starts > 0)], 5)
    places = np.flatnonzero(priority)
    return places, priority[places]


def chunks(text: str, chars_a_token: int = 4) -> list[str]:
    """The chunks of a normalised text: as it is up to MOST tokens, else cut at the last place of the highest priority
    between LEAST and MOST tokens, at MOST where there is none; the next begins OVERLAP tokens before the cut."""
    if not text:
        return []
    codes = _codes(text)
    wide = np.zeros(len(codes), dtype=bool)
    wide[[m.start() for m in _CJK.finditer(text)]] = True
    total = np.concatenate(([0], np.cumsum(np.where(wide, chars_a_token, 1), dtype=np.int64)))
    if total[-1] <= MOST * chars_a_token:
        return [text]
    places, priority = boundaries(text)
    out, start = [], 0
    while start < len(codes):
        within = lambda tokens: int(np.searchsorted(total, total[start] + tokens * chars_a_token, side="right")) - 1
        end = within(MOST)
        if end >= len(codes):
            out.append(text[start:].strip())
            break
        first, past = np.searchsorted(places, within(LEAST)), np.searchsorted(places, end, side="right")
        if past > first:
            end = int(places[first:past][priority[first:past] == priority[first:past].max()][-1])
        out.append(text[start:end].strip())
        back = int(np.searchsorted(total, total[end] - OVERLAP * chars_a_token, side="left"))
        start = back if back > start else end
    return [c for c in out if c]


def page_chunks(pages: DataFrame) -> DataFrame:
    """(book_id, page, chunk_id, text, content_hash): the chunks of each page's normalised text; blank pages have none."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(b, p, f"{VERSION}:{i}", c) for b, p, t in zip(batch["book_id"], batch["page"], batch["text"]) for i, c in enumerate(chunks(t))]
            yield pd.DataFrame(rows, columns=["book_id", "page", "chunk_id", "text"])

    normal = pages.select("book_id", "page", T.page_text(F.coalesce("text", F.lit(""))).alias("text"))
    return normal.mapInPandas(made, "book_id string, page int, chunk_id string, text string").withColumn("content_hash", F.sha2("text", 256))
