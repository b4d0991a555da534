"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. What a line shows (lengths, shares of kinds of characters, repeated words and lines, the
words' shapes) and what its neighbours show are the field's features; transitions tie neighbours' labels. Forward and
backward sums give each line's marginal; weighted by length, these make the document's quality, which a logistic curve
turns into the chance of label 1.

Only documents are labelled. Lines begin with their document's label; then lines of bad documents that the field
finds good in the greater part are taken as good, and it is fitted again. The fit is on at most TRAIN_DOCS labelled
documents (drawn by hash), by gradient ascent of the conditional likelihood. Of a document of more than TRAIN_LINES
lines the fit sees a stretch of so many, drawn by hash; scores are always those of all lines.

Null and empty texts are one empty line. Very long texts cost memory and steps in proportion to their lines. Repeated
rows score alike; of several labels of a document the greatest holds. Without labels of both kinds the score is 1, or 0
if all labels are. An empty table has no scores. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, SPACE, pieces, texts_of, word_hashes
from .common import small_batches

#: Labelled documents that the field is fitted on at most, about.
TRAIN_DOCS = 6_000
#: Lines of one of them at most, so that the driver holds about TRAIN_DOCS * TRAIN_LINES lines (110 MB of features).
TRAIN_LINES = 40

_KINDS = np.zeros((7, 256), dtype=np.float32)
_KINDS[0, 65:91] = 1  # upper case
_KINDS[1, 97:123] = 1  # lower case
_KINDS[2, 48:58] = 1  # digits
_KINDS[3, [33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 96, 124, 126, 123, 125, 91, 93]] = 1  # signs
_KINDS[4, [44, 46, 58, 59, 63, 34, 39, 40, 41, 45]] = 1  # punctuation
_KINDS[5, 128:] = 1  # other alphabets
_KINDS[6, [9, 10, 11, 12, 13, 32]] = 1  # white space


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[ends] - total[starts]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every line of every text; an empty text has one."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    text = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(feeds, offsets)))
    ends = np.sort(np.concatenate((offsets[1:], feeds)), kind="stable")
    return text, starts, ends


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight, features) of every line."""
    text, starts, ends = _lines(data, offsets)
    size = (ends - starts).astype(np.float64)
    kinds = np.stack([_sums(k[data], starts, ends) for k in _KINDS], axis=1)
    shares = kinds / np.maximum(size, 1)[:, None]
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    word_starts = np.flatnonzero(ink & (edge[:-1] | np.concatenate(([True], ~ink[:-1]))[: len(ink)]))
    word_ends = np.flatnonzero(ink & (edge[1:] | np.concatenate((~ink[1:], [True]))[: len(ink)])) + 1
    a, b = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    words = (b - a).astype(np.float64)
    hashes = word_hashes(data, word_starts, word_ends)
    again = np.concatenate(([False], hashes[1:] == hashes[:-1]))[: len(hashes)]
    caps = _sums(_KINDS[0][data], word_starts, word_ends) >= np.maximum(2, 0.6 * (word_ends - word_starts))
    alone = (word_ends - word_starts == 1) & (_KINDS[3][data[word_starts]] > 0)
    last = data[np.maximum(word_ends - 1, 0)]
    signed = (_KINDS[3][last] > 0) & (word_ends - word_starts > 1)
    lengths = (word_ends - word_starts).astype(np.float64)
    per_word = np.stack([_sums(x.astype(np.float64), a, b) for x in (again, caps, alone, signed, lengths, lengths**2)], axis=1) / np.maximum(words, 1)[:, None]
    spread = np.sqrt(np.maximum(per_word[:, 5] - per_word[:, 4] ** 2, 0))
    line_hash = np.zeros(len(starts), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
    line_hash = total[b] - total[a] + words.astype(np.uint64)
    order = np.lexsort((starts, line_hash, text))
    repeated = np.zeros(len(starts), dtype=bool)
    repeated[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & (words[order[1:]] > 0)
    ended = np.isin(data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8), [46, 33, 63]) & (size > 0)
    own = np.column_stack((np.log1p(size), np.log1p(words), words == 0, shares[:, :6], per_word[:, :5], spread, repeated, ended))
    # A line sees the line before and after it in its text.
    first = np.concatenate(([True], text[1:] != text[:-1]))
    past = np.concatenate((text[1:] != text[:-1], [True]))
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(past[:, None], 0, np.roll(own, -1, axis=0))
    return text, np.maximum(words, 1), np.column_stack((own, before[:, 2:], after[:, 2:], first, past)).astype(np.float64)


def marginals(score: np.ndarray, transitions: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each line's chance of being good, expected transitions of all) by forward and backward sums, all texts at once.

    score: log-potential of good against bad. Texts are walked in step, longest first, so a step is one array operation.
    """
    n = np.bincount(text) if len(text) else np.zeros(0, int)
    begin = np.concatenate(([0], np.cumsum(n)))[:-1]
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], begin[order]
    m = np.exp(transitions - transitions.max())
    emit = np.column_stack((np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))))
    forward, backward = np.empty((len(score), 2)), np.empty((len(score), 2))
    longest = int(n[0]) if len(n) else 0
    for t in range(longest):
        at = begin[: np.searchsorted(-n, -t, side="left")] + t
        f = emit[at] if t == 0 else (forward[at - 1] @ m) * emit[at]
        forward[at] = f / f.sum(axis=1, keepdims=True)
    for t in range(longest):
        live = np.searchsorted(-n, -t, side="left")
        at = begin[:live] + n[:live] - 1 - t
        if t == 0:
            backward[at] = 1
        else:
            b = (backward[at + 1] * emit[at + 1]) @ m.T
            backward[at] = b / b.sum(axis=1, keepdims=True)
    good = forward * backward
    good /= good.sum(axis=1, keepdims=True)
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, int)
    joint = forward[pair][:, :, None] * m[None] * (backward[pair + 1] * emit[pair + 1])[:, None, :]
    return good[:, 1], (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Field:
    def __init__(self, features: int):
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.weights, self.bias, self.transitions = np.zeros(features), 0.0, np.zeros((2, 2))
        self.curve = np.zeros(5)

    def line_marginals(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        return marginals((features - self.mean) / self.scale @ self.weights + self.bias, self.transitions, text)[0]

    def fit_lines(self, features: np.ndarray, text: np.ndarray, good: np.ndarray, weight: np.ndarray, steps: int = 150) -> None:
        """Adam on the conditional likelihood; `weight` evens out good and bad."""
        x = (features - self.mean) / self.scale
        labels = good.astype(int)
        pair = text[1:] == text[:-1]
        seen = np.array([[(pair & (labels[:-1] == i) & (labels[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
        theta = np.concatenate((self.weights, [self.bias], self.transitions.ravel()))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            self.weights, self.bias, self.transitions = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
            p, pairs = marginals(x @ self.weights + self.bias, self.transitions, text)
            off = (good - p) * weight
            g = np.concatenate((off @ x, [off.sum()], (seen - pairs).ravel())) / len(x) - 1e-4 * theta
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta = theta + 0.08 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights, self.bias, self.transitions = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)

    def summaries(self, features: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """A document's length-weighted chance of bad lines, its logit, its worst line and its logarithm of words."""
        bad = 1 - self.line_marginals(features, text)
        total = np.bincount(text, weight, texts)
        share = np.bincount(text, bad * weight, texts) / total
        worst = np.zeros(texts)
        np.maximum.at(worst, text, bad)
        return np.column_stack((share, np.log((share + 1e-3) / (1 - share + 1e-3)), worst, np.log(total)))

    def scores(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + summaries @ self.curve[1:], -50, 50)))

    def fit_curve(self, summaries: np.ndarray, label: np.ndarray) -> None:
        x = np.column_stack((np.ones(len(summaries)), summaries))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
            self.curve = self.curve - np.clip(np.linalg.solve(hess, x.T @ (p - label) + 1e-2 * self.curve), -1, 1)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, label): weights and features of all lines or of a stretch of TRAIN_LINES, a row for each document."""
    for batch in batches:
        out, ids = [], batch.column("doc_id").to_pylist()
        for _, _, data, offsets in pieces(*texts_of(batch.column("text"))):
            text, weight, x = line_features(data, offsets)
            cuts = np.flatnonzero(np.diff(text)) + 1
            for w, f in zip(np.split(weight, cuts), np.split(x, cuts)):
                first = crc32(b"%d" % (ids[len(out)] or 0)) % max(1, len(w) - TRAIN_LINES + 1)
                part = slice(first, first + TRAIN_LINES)
                out.append((w[part].astype(np.float32).tobytes(), f[part].astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([w for w, _ in out], pa.binary()), pa.array([f for _, f in out], pa.binary())], ["doc_id", "label", "w", "x"])


def train(docs: DataFrame, labels: DataFrame, rounds: int = 3) -> Field:
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("l"), F.col("quality").alias("label")).where("label IS NOT NULL").groupBy("l").agg(F.max("label").alias("label"))
    n = known.count()
    drawn = F.broadcast(known.where(F.shiftrightunsigned(F.xxhash64("l"), 1) < F.lit(min(2**63 - 1, int(2**63 * min(1.0, TRAIN_DOCS / max(n, 1)))))))
    rows = docs.select("doc_id", "text").where(~held_out()).join(drawn, F.col("doc_id") == F.col("l")).selectExpr("cast(doc_id AS long) AS doc_id", "text", "cast(label AS int) AS label")
    rows = rows.mapInArrow(_featured, "doc_id long, label int, w binary, x binary").toPandas().sort_values(["doc_id", "x"], kind="stable")  # about TRAIN_DOCS rows of TRAIN_LINES lines
    weights = [np.frombuffer(w, np.float32) for w in rows["w"]]
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[2].shape[1]
    field, label = Field(width), rows["label"].to_numpy()
    if not len(label) or label.min() == label.max():
        field.curve[0] = -50.0 if len(label) and label[0] == 0 else 50.0
        return field
    x = np.concatenate([np.frombuffer(f, np.float32).reshape(-1, width) for f in rows["x"]]).astype(np.float64)
    text, weight = np.repeat(np.arange(len(label)), [len(w) for w in weights]), np.concatenate(weights).astype(np.float64)
    field.mean, field.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    good = label[text].astype(np.float64)
    for _ in range(rounds):
        share = good.mean()
        field.fit_lines(x, text, good, np.where(good > 0, 1 / max(2 * share, 1e-3), 1 / max(2 * (1 - share), 1e-3)))
        p = field.line_marginals(x, text)
        # In a bad document the worst line stays bad, whatever the field says.
        worst = np.ones(len(label))
        np.minimum.at(worst, text, p)
        good = np.where(label[text] == 1, 1.0, ((p > 0.6) & (p > worst[text])).astype(float))
    field.fit_curve(field.summaries(x, text, weight, len(label)), label)
    return field


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) of each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(len(batch))
            for first, past, data, offsets in pieces(*texts_of(batch.column("text"))):
                text, weight, x = line_features(data, offsets)
                out[first:past] = shared.value.scores(shared.value.summaries(x, text, weight, past - first))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(score, "doc_id long, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
