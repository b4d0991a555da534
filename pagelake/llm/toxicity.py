"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words sums, over all subsequences of `ORDER` letters that both have, the decay `DECAY` to the power
of the letters they span; normalised, it is 1 for equal words and stays high where letters are inserted or endings
differ. Letters only: digits and punctuation in a word are insertions that are skipped at the cost of the gap, and a
run of single letters ("i d i o t") is one more word.

Training, on labelled documents only: words that tell toxic texts apart are counted; the
landmarks are those words or stems of them that cover most of the evidence. A text's sentence that is nearest to the
landmarks stands for it. Its feature for a landmark is the kernel's maximum over its words; the Nyström map turns
these into coordinates whose inner products are the kernel's. A linear SVM with hinge loss is fitted to the sentences,
of about TRAIN_ROWS rows at most (drawn by hash), and a logistic curve to a text's two worst margins and its length.
The fit is a few hundred numbers.

Scoring is one pass over whole texts; a very long text is one numpy array, some 60 bytes of memory a byte. Null and
empty texts, and texts without a word near a landmark, get the score of no feature. Without labels of both kinds every
score is near 0; an empty table gives no rows. Repeated rows score alike; ties between sentences don't change a score.
Extra columns are not read by `scored` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, pieces, texts_of
from .common import ascii_lower, small_batches, without, written

ORDER, DECAY = 3, 0.7
LANDMARKS = 48
#: Labelled rows that the machine is fitted on at most (about), and words that the landmarks are chosen from.
TRAIN_ROWS, CANDIDATES = 20_000, 4_000
#: Evidence in nats that makes a word a candidate.
EVIDENCE = 14.0
#: Kernels below this count as nothing; words that can't reach it for want of common letters are skipped.
FLOOR = 0.4
#: Letters of a word that the kernel looks at at once; longer words are looked at in halves that overlap.
WIDTH = 24
#: Words whose kernels a task keeps (4 bytes a landmark each).
KEPT_WORDS = 200_000

#: Bits of a-z; other letters share the six bits that are left, by byte.
_BIT = np.zeros(256, dtype=np.uint32)
for _b in range(97, 123):
    _BIT[_b] = np.uint32(1) << np.uint32(_b - 97)
for _b in range(128, 256):
    _BIT[_b] = np.uint32(1) << np.uint32(26 + _b % 6)
#: Numbers of letters: a-z, and each byte of other letters.
CODES = 26 + 128 + 1
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = np.arange(27, CODES)
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True  # line feed ! . ?


def _keys(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(words, places): the subsequences of words of one length as numbers."""
    letters = _CODE[rows].astype(np.int32)
    return (letters[:, places[:, 0]] * CODES + letters[:, places[:, 1]]) * CODES + letters[:, places[:, 2]]


def triples(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of words as rows of bytes: each subsequence of ORDER letters that a word has, once, with
    the sum over its places of DECAY to the power of the letters that the place spans. Sorted by word and subsequence.

    Words of one length have the same places, so a length's words are one table of words by places.
    """
    lengths = (rows != 0).sum(axis=1)
    words, keys, weights = [], [], []
    for n in np.unique(lengths[lengths >= ORDER]).tolist():
        places, weight = _places(n)
        of = np.flatnonzero(lengths == n)
        for at in range(0, len(of), max(1, 500_000 // len(places))):
            part = of[at : at + max(1, 500_000 // len(places))]
            flat = (_keys(rows[part], places) + part[:, None] * CODES**3).ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            weights.append(np.add.reduceat(weight[order % len(places)], first))
            words.append(flat[first] // CODES**3)
            keys.append(flat[first] % CODES**3)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word, key, weight = np.concatenate(words), np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(word, kind="stable")
    return word[order], key[order], weight[order]


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ORDER letters in a word of n, and their weights."""
    if n not in _PLACES:
        places = np.array(list(combinations(range(n), ORDER)))
        _PLACES[n] = places, DECAY ** (places[:, -1] - places[:, 0] + 1.0)
    return _PLACES[n]


def least_norm(n: int) -> float:
    return float(np.sqrt((_places(n)[1] ** 2).sum()))


_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _rows(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)


_NO_LETTERS = bytes(c for c in range(128) if not 97 <= c <= 122)


def _letters(word: bytes) -> bytes:
    return word.translate(None, _NO_LETTERS)


def _halves(word: bytes) -> list[bytes]:
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


class Landmarks:
    """Words, and their subsequences as one table; gives the normalised kernels of any word with them.

    A kernel of two words is the inner product of their subsequences' weights. So the landmarks' weights, divided by
    their norms, are a matrix over the subsequences that any of them has, and a word's kernels with all landmarks at once
    are its own few rows of that matrix, weighted and summed.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        self.masks = np.array([np.bitwise_or.reduce(_BIT[np.frombuffer(w, np.uint8)]) for w in words], dtype=np.uint32)
        # A word that is near has most of a landmark's letters.
        self.least = np.maximum(np.ceil(np.bitwise_count(self.masks) * 0.75), 2).astype(np.uint8)
        word, key, weight = triples(_rows(words, WIDTH)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        norms = np.sqrt(np.maximum(np.bincount(word, weight**2, len(words)), 1e-12))
        known, column = np.unique(key, return_inverse=True)
        # The last row, of zeros, is that of subsequences that no landmark has.
        self.table = np.zeros((len(known) + 1, len(words)), dtype=np.float32)
        self.table[column, word] = weight / norms[word]
        self.known = known
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[bytes, int] = {}
        self.values = np.zeros((1024, len(self.words)), dtype=np.float32)

    def __getstate__(self) -> dict:
        """What goes to the tasks: without the words met so far, and the subsequences' numbers are made again there."""
        return {k: v for k, v in self.__dict__.items() if k not in ("row_of", "values", "number")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Rows of `table`, by a table over all subsequences."""
        if not hasattr(self, "number"):
            self.number = np.full(CODES**3, len(self.known), dtype=np.int32)
            self.number[self.known] = np.arange(len(self.known))
        return self.number[keys]

    def near(self, masks: np.ndarray) -> np.ndarray:
        """Of words by their letters: which may be near a landmark."""
        distinct, back = np.unique(masks, return_inverse=True)
        found = np.zeros(len(distinct), dtype=bool)
        for mask, least in zip(self.masks, self.least):
            found |= np.bitwise_count(distinct & mask) >= least
        return found[back]

    def kernels(self, words: list[bytes]) -> np.ndarray:
        """(words, landmarks) of normalised kernels, 0 below FLOOR; of a long word the greatest of its halves'."""
        values = np.zeros((len(words), len(self.words)), dtype=np.float32)
        halves = [(i, h) for i, w in enumerate(words) for h in _halves(_letters(w))]
        if not halves or not self.words:
            return values
        owner, rows = np.array([i for i, _ in halves]), _rows([h for _, h in halves], WIDTH)
        masks = np.bitwise_or.reduce(_BIT[rows], axis=1)
        word, dots = self._dots(rows)
        dots[np.bitwise_count(masks[word][:, None] & self.masks[None, :]) < self.least[None, :]] = 0
        near = dots.max(axis=1) >= FLOOR
        word, dots = word[near], dots[near]
        of, _, weight = triples(rows[word])
        norms = np.sqrt(np.maximum(np.bincount(of, weight**2, len(word)), 1e-12))
        sums = dots * (np.array([least_norm(n) for n in (rows[word] != 0).sum(axis=1)]) / norms).astype(np.float32)[:, None]
        np.maximum.at(values, owner[word], np.where(sums >= FLOOR, sums, 0))
        return values

    def _dots(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, bounds): of words with a landmark's subsequence, what their kernels are at most.

        The inner products with the landmarks, divided by the least norm that a word of so many letters can have: that
        of different subsequences at all its places. Only words that this leaves need their norms.
        """
        lengths = (rows != 0).sum(axis=1)
        words, dots = [np.zeros(0, np.int64)], [np.zeros((0, len(self.words)), np.float32)]
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            places, weight = _places(n)
            of, share = np.flatnonzero(lengths == n), (weight / least_norm(n)).astype(np.float32)
            step = max(1, 1_200_000 // len(places) // max(1, len(self.words) // 16))
            for at in range(0, len(of), step):
                number = self.numbers(_keys(rows[of[at : at + step]], places))
                word, place = np.nonzero(number < len(self.known))
                if len(word):
                    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                    dots.append(np.add.reduceat(self.table[number[word, place]] * share[place][:, None], first, axis=0))
                    words.append(of[at + word[first]])
        return np.concatenate(words), np.concatenate(dots)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The kernels of `words`, kept by word, as words repeat."""
        new = [w for w in dict.fromkeys(words) if w not in self.row_of]
        if len(self.row_of) + len(new) > KEPT_WORDS and self.row_of:
            self.forget()
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            size = len(self.row_of)
            while size + len(part) > len(self.values):
                self.values = np.concatenate((self.values, np.zeros_like(self.values)))
            self.values[size : size + len(part)] = self.kernels(part)
            self.row_of.update(zip(part, range(size, size + len(part))))
        return self.values[np.fromiter((self.row_of[w] for w in words), np.int64, len(words))]


def sentence_features(column: pa.Array, marks: Landmarks) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: its first and past, the words of each, and (text, features) of the sentences that have a word near a landmark."""
    none = np.zeros(0, dtype=np.int64), np.zeros((0, len(marks.words)), dtype=np.float32)
    for first, past, data, offsets in pieces(*texts_of(column)):
        low = LOWER[data]
        ink = _WORD_BYTE[low]
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(ink & (edge[:-1] | np.concatenate(([True], ~ink[:-1]))))
        counts = np.diff(np.searchsorted(starts, offsets))
        if not len(starts):
            yield first, past, counts, *none
            continue
        ends = np.flatnonzero(ink & (edge[1:] | np.concatenate((~ink[1:], [True])))) + 1
        masks = np.bitwise_or.reduceat(_BIT[low], starts)
        letters = np.diff(np.concatenate(([0], np.cumsum(_BIT[low] != 0))), prepend=0)[1:]
        count = np.add.reduceat(letters, starts)
        text = np.searchsorted(offsets, starts, side="right") - 1
        sentence = np.concatenate(([0], np.cumsum(_ENDS[low])))[starts] + text  # grows with either
        raw = low.tobytes()
        at = np.flatnonzero(marks.near(masks) & (count >= 3))
        words = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
        # Runs of four or more words of one letter each make a word.
        single = count == 1
        turn = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if b - a >= 4:
                words.append(_letters(raw[starts[a] : ends[b - 1]]))
                at = np.append(at, a)
        if not words or not marks.words:
            yield first, past, counts, *none
            continue
        values = marks.of(words)
        keep = values.max(axis=1) > 0
        keys, back = np.unique(np.stack((text[at[keep]], sentence[at[keep]]), axis=1), axis=0, return_inverse=True)
        out = np.zeros((len(keys), len(marks.words)), dtype=np.float32)
        np.maximum.at(out, back.ravel(), values[keep])
        yield first, past, counts, keys[:, 0] + first, out


class Model:
    """Landmarks, the Nyström map, the machine's weights and the curve from margins to scores."""

    def __init__(self, words: list[bytes]):
        self.marks = Landmarks(words)
        self.map, self.weights, self.bias, self.curve = np.eye(len(words)), np.zeros(len(words)), 0.0, np.zeros(4)

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ (self.map @ self.weights) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + margins @ self.curve[1:], -50, 50)))

    def fit(self, features: np.ndarray, labels: np.ndarray, steps: int = 3_000, penalty: float = 1e-4, seed: int = 0) -> None:
        gram = self.marks.of(self.marks.words).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        self.map = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2)))
        x, y = features @ self.map, np.where(labels > 0, 1.0, -1.0)
        share = np.array([(y < 0).mean(), (y > 0).mean()])
        cost = np.where(y > 0, share[0], share[1]) / max(2 * share[0] * share[1], 1e-9)
        rng = np.random.default_rng(seed)
        w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
        for t in range(1, steps + 1):
            i = rng.integers(0, len(x), 256)
            wrong = (y[i] * (x[i] @ w + b) < 1) * cost[i] * y[i] / len(i)
            rate = 1 / (penalty * (t + 10_000))
            w, b = w - rate * (penalty * w - wrong @ x[i]), b + rate * wrong.sum()
            if t > steps // 2:
                mean_w, mean_b = mean_w + w, mean_b + b
        self.weights, self.bias = mean_w / (steps - steps // 2), mean_b / (steps - steps // 2)

    def calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Platt's curve over a text's two worst margins and the logarithm of its words, by Newton's method, with his softened targets."""
        positives = (labels > 0).sum()
        target = np.where(labels > 0, (positives + 1) / (positives + 2), 1 / (len(labels) - positives + 2))
        x = np.column_stack((np.ones(len(margins)), margins))
        curve = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            curve = curve - np.clip(np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * curve), -1, 1)
        self.curve = curve


def _worst(n: int, parts: Iterator[tuple], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of n texts, from `sentence_features`: (two worst sentences' margins, the logarithm of the words), and the worst sentence's features.

    Ties between sentences go to the greatest features, compared from the last landmark on, so the order doesn't matter.
    """
    out = np.full((n, 3), model.bias)
    rows = np.zeros((n, len(model.marks.words)), dtype=np.float32)
    out[:, 2] = 0
    for first, past, counts, text, features in parts:
        out[first:past, 2] = np.log1p(counts)
        if not len(text):
            continue
        margin = model.margins(features)
        order = np.lexsort((*features.T, margin, text))
        text, margin, features = text[order], margin[order], features[order]
        last = np.flatnonzero(np.diff(np.append(text, -1)))
        second = last[(last > 0) & (text[last - 1] == text[last])] - 1
        rows[text[last]] = features[last]
        out[text[last], 0] = np.maximum(margin[last], model.bias)
        out[text[second], 1] = np.maximum(margin[second], model.bias)
    return out, rows


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label): about TRAIN_ROWS labelled rows that aren't held out, drawn by hash.

    Of several labels of a document the greatest holds; of equal texts one stays, of those with the greatest label the
    smallest doc_id.
    """
    known = labels.select(F.col("doc_id").alias("l"), F.col("toxic").alias("label")).where("label IS NOT NULL").groupBy("l").agg(F.max("label").alias("label"))
    n = known.count()
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("l"), 1) < F.lit(min(2**63 - 1, int(2**63 * min(1.0, TRAIN_ROWS / max(n, 1))))))
    drawn = F.broadcast(drawn)  # TRAIN_ROWS rows
    rows = docs.select("doc_id", "text").where(~held_out()).join(drawn, F.col("doc_id") == F.col("l")).select("doc_id", "text", "label")
    one = F.max_by(F.struct("doc_id", "text", "label"), F.struct("label", -F.col("doc_id").cast("long")))
    return written(rows.groupBy(F.sha2("text", 256).alias("d")).agg(one.alias("r")).select("r.*"))


def landmark_words(training: DataFrame) -> list[bytes]:
    """Words or beginnings of words (letters, lower-cased) that cover most of the evidence of toxic texts, best first.

    A word's or beginning's evidence is n D(t / n || q): n training texts have it, t of them toxic, where a share q is
    toxic in all. EVIDENCE is more than the luckiest of the many would reach. Common words of other texts count
    against a landmark that is near them.
    """
    plain = F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\s]+", " ")
    each = training.select("label", F.explode_outer(F.array_distinct(F.split(plain, r"\s+"))).alias("word")).where("length(word) >= 3")
    begun = F.array(F.lit(0), *(F.when(F.length("word") > k, F.lit(k)) for k in (4, 5, 6, 7)))
    each = each.select("label", "word", F.explode_outer(F.array_compact(begun)).alias("k"))
    each = each.select("label", "k", F.when(F.col("k") == 0, F.col("word")).otherwise(F.substring(F.col("word"), F.lit(1), F.col("k"))).alias("word"))
    sums = each.groupBy("k", "word").agg(F.sum("label").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    row = training.agg(F.avg("label").alias("q")).first()
    if not row["q"] or row["q"] == 1:
        return []
    q, share = F.lit(row["q"]), F.col("t") / F.col("n")
    evidence = F.col("n") * (F.when(share > 0, share * F.log(share / q)).otherwise(0.0) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - q))).otherwise(0.0))
    told = sums.where(share > 3 * q).withColumn("e", evidence).where(F.col("e") >= EVIDENCE).orderBy(F.col("e").desc(), "k", "word").limit(CANDIDATES).collect()
    other = sums.where("k = 0").where(share < 1.5 * q).orderBy(F.col("n").desc(), "word").limit(CANDIDATES).collect()
    told = [(w, r["e"]) for r in told if len(w := _letters(r["word"].encode())[:WIDTH]) > ORDER]
    if not told:
        return []
    words, gains = [w for w, _ in told], np.array([e for _, e in told])
    stems = list(dict.fromkeys(words[:1_000]))
    near = Landmarks(stems)
    covers = near.of(words)
    against = (near.of([_letters(r["word"].encode())[:WIDTH] for r in other]) * np.array([[r["n"]] for r in other])).sum(axis=0) if other else np.zeros(len(stems))
    chosen: list[int] = []
    left = np.ones(len(words))
    while len(chosen) < LANDMARKS:
        worth = (covers * (gains * left)[:, None]).sum(axis=0) - against
        worth[chosen] = 0
        pick = int(worth.argmax())
        if worth[pick] < EVIDENCE:
            break
        chosen.append(pick)
        left *= 1 - covers[:, pick]
    return [stems[i] for i in chosen]


def train(docs: DataFrame, labels: DataFrame, rounds: int = 2) -> Model:
    small_batches(docs.sparkSession)
    training = training_rows(docs, labels)
    words = landmark_words(training)
    model = Model(words)
    if not words:
        model.curve[0] = -50.0
        return model
    featured = training_features(training, model.marks)
    # Which sentence stands for a text is decided by kernels alone at first, then by the machine of the round before.
    model.weights = np.ones(len(words))
    for _ in range(rounds):
        _, x, y = _bags(featured, model)
        model.fit(x, y)
    margins, _, y = _bags(featured, model)
    model.calibrate(margins, y)
    return model


def training_features(training: DataFrame, marks: Landmarks) -> DataFrame:
    """(doc_id, label, words, x): of each training text the features of its sentences, worked out once for all rounds."""
    shared = training.sparkSession.sparkContext.broadcast(marks)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, x = np.zeros(len(batch), dtype=np.int64), [b""] * len(batch)
            for first, past, counts, text, features in sentence_features(batch.column("text"), shared.value):
                words[first:past] = counts
                bounds = np.searchsorted(text, np.arange(first, past + 1))
                for i in range(past - first):
                    x[first + i] = features[bounds[i] : bounds[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(words), pa.array(x, pa.binary())], ["doc_id", "label", "words", "x"])

    rows = training.selectExpr("cast(doc_id AS long) AS doc_id", "text", "cast(label AS int) AS label")
    return written(rows.mapInArrow(made, "doc_id long, label int, words long, x binary"))


def _bags(featured: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(margins, features of the worst sentence, label) of the training texts, in an order that doesn't depend on Spark."""
    shared = featured.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x.as_py(), np.float32).reshape(-1, len(shared.value.marks.words)) for x in batch.column("x")]
            text = np.repeat(np.arange(len(batch)), [len(x) for x in each])
            part = 0, len(batch), batch.column("words").to_numpy(), text, np.concatenate(each) if each else np.zeros((0, 0), np.float32)
            margins, rows = _worst(len(batch), iter([part]), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(margins), pa.list_(pa.float64())), pa.array(list(rows), pa.list_(pa.float32()))], ["doc_id", "label", "m", "x"])

    rows = featured.mapInArrow(made, "doc_id long, label int, m array<double>, x array<float>")
    rows = rows.toPandas().sort_values("doc_id", kind="stable")  # about TRAIN_ROWS rows
    return np.array(rows["m"].tolist()).reshape(len(rows), 3), np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), -1), rows["label"].to_numpy()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins, _ = _worst(len(batch), sentence_features(batch.column("text"), shared.value.marks), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(margins))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without those whose score is `threshold` or more; all columns as they are."""
    toxic = scored(docs, train(docs, labels)).where(F.col("score") >= threshold)
    return without(docs, toxic.select(F.col("doc_id").alias("gone_id")).distinct())


def op9(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
