"""Where many strings stand in many texts, by winnowed fingerprints.

A text's fingerprints are, of each SPAN successive hashes of GRAM characters, the least. A text that contains a string of
GRAM + SPAN - 1 characters or more has all the fingerprints of the string, so a string is looked up by the one that the
fewest texts have. Shorter strings are looked up by the hash of all their characters. What is found so is verified beside
the text, which reads each text once whatever the number of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import few

GRAM, SPAN = 8, 8
LONG = GRAM + SPAN - 1

_FACTORS = np.cumprod(np.full(LONG, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n characters in a row."""
    size = max(0, len(points) - n + 1)
    out = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        out += (points[j : j + size] + np.uint64(1)) * _FACTORS[j]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def fingerprints(text: str, lengths: tuple[int, ...] = (), whole: bool = False) -> np.ndarray:
    """A text's distinct winnowed hashes, and the hashes of all its strings of `lengths`; `whole`: a short text's own hash."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if whole and len(points) < LONG:
        return gram_hashes(points, len(points))
    found = [gram_hashes(points, n) for n in lengths]
    if len(points) >= LONG:
        found.append(np.lib.stride_tricks.sliding_window_view(gram_hashes(points, GRAM), SPAN).min(axis=1))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _made(lengths: tuple[int, ...], whole: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                prints = fingerprints(text.as_py(), lengths, whole).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(row, len(prints)), pa.array(prints)], ["row", "print"])

    return made


def containing(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(…, q): which texts contain which forms. texts: (…, m); forms: (q).

    A text and a form that it contains, once or more often, give one row; repeated texts are rows of their own. Null and
    empty texts and forms are found nowhere. A very long text is one unit of work. Columns of `texts` but m are handed on.
    """
    forms = written(forms.select("q").where("q <> ''").distinct())
    held = written(texts.where("m <> ''").withColumn("_row", F.monotonically_increasing_id()))
    lengths = tuple(sorted(r[0] for r in forms.where(F.length("q") < LONG).select(F.length("q")).distinct().collect()))  # LONG - 1 at most
    sought = written(forms.select(F.monotonically_increasing_id().alias("row"), "q"))
    prints = written(sought.select("row", "q").mapInArrow(_made((), True), "row long, print long").withColumnRenamed("row", "form"))
    keys = prints.select("print").distinct()
    met = written(held.select("_row", "m").mapInArrow(_made(lengths, False), "row long, print long").join(few(keys), "print"))
    counts = met.groupBy("print").agg(F.count("*").alias("n"))
    rarest = prints.join(counts, "print", "left").groupBy("form").agg(F.min_by("print", F.struct(F.coalesce("n", F.lit(0)), "print")).alias("print"))
    chosen = rarest.join(sought.withColumnRenamed("row", "form"), "form").select("print", "q")
    by_text = met.join(chosen, "print").groupBy("row").agg(F.collect_set("q").alias("_q"))
    verified = held.join(by_text.withColumnRenamed("row", "_row"), "_row").withColumn("q", F.explode(F.filter("_q", lambda q: F.contains(F.col("m"), q))))
    return verified.select(*[f"`{c}`" for c in texts.columns if c != "m"], "q")
