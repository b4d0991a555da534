"""Packing of documents into token windows by best-fit decreasing.

Documents become token ids; overlong ones are cut into full windows and one shorter rest. Pieces are dealt evenly over
groups of about GROUP pieces, by numbers given where they were made, so equal ids or a large source weigh on no group. In
a group pieces go in by descending length, each into the tightest open window that has room, found by a segment tree
indexed by remaining capacity; where none has room, a window is opened. A group leaves a window or two partly filled.

A tokenizer that drops white space and splits at it never looks past it, so a text's ids are those of its words in turn;
the ids of short words are kept in the worker, about KEPT of them. A test holds that against encoding whole texts.

A null or empty text is the end mark alone. Every row is a document, whether or not its doc_id is null or repeated; equal
lengths go in by the pieces' numbers. A very long text is one unit of work, in memory in proportion to it, and its pieces
are dealt like any others. An empty table gives no rows. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Tokens of a window, the id that ends a document, and pieces of a group, about.
WINDOW, END_ID, GROUP = 4_096, 2, 16_384
#: Words whose ids a worker keeps, and the bytes that such a word has at most.
KEPT, SHORT = 1_000_000, 48
#: How the tokenizer that words are cut for normalises and splits.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Words that fall into runs of letters and runs of other ASCII, which that tokenizer always splits: no apostrophe, which
#: may belong to the letters behind it, no "<", which may begin a special token.
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_LETTER, _RUNS = re.compile(r"[a-zß-öø-ÿ]"), re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers, by any `tokenizers` file.

    Where the file is known to drop white space and to split at it, a text is encoded word by word, and a word's runs of
    letters go to the model itself. Other files encode whole texts.
    """

    def __init__(self, model: str, specials_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = specials_as_text
        spec = json.loads(model)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        first = cuts[0] if len(cuts) == 2 and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"] else {}
        self.by_word = steps == NORMALIZERS and first.get("pattern") == {"Regex": SPLIT} and first["behavior"] == "Removed" and first["invert"]
        self.model, self.kept = self.tokenizer.model, {}
        bytelevel = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: bytelevel.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}

    def _plainly(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if _LETTER.match(run):
            found = self.model.tokenize(run if run.isascii() else run.translate(self.letters))
            ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        else:
            ids = self._plainly(run)
        if len(ids) <= SHORT:
            self.kept[run.encode()] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not _PLAIN.fullmatch(text):
            return self._plainly(text)
        return b"".join([self.kept.get(run.encode()) or self._run(run) for run in _RUNS.findall(text.lower())])

    def encoded(self, text: str | None) -> bytes:
        if not self.by_word:
            return self._plainly(text or "")
        kept, words = self.kept, (text or "").encode().split()
        distinct = set(words)
        new = [w for w in distinct if w not in kept]
        if new and len(kept) > KEPT:
            kept.clear()
            new = list(distinct)
        for w in new:
            kept[w] = self._word(w)
        found = b"".join(map(kept.__getitem__, words))
        for w in new:
            if len(w) > SHORT:
                del kept[w]
        return found


_workers: dict[tuple[int, bool], Encoder] = {}


def encoder(model: str, specials_as_text: bool = True) -> Encoder:
    """This worker's encoder of a model."""
    key = (zlib.crc32(model.encode()), specials_as_text)
    if key not in _workers:
        _workers[key] = Encoder(model, specials_as_text)
    return _workers[key]


def _pieces(model, window: int, end_id: int, specials_as_text: bool, with_ids: bool):
    """For mapInArrow over (doc_id, text): a row for each piece of each document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, worker = TaskContext.get().partitionId() << 40, encoder(model.value, specials_as_text)
        for batch in batches:
            out: dict[str, list] = {"piece_id": [], "at": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": [], "ids": []}
            for at, text in enumerate(batch.column("text")):
                ids = worker.encoded(text.as_py()) + end
                for start in range(0, len(ids), 4 * window):
                    piece = ids[start : start + 4 * window]
                    for name, value in (("piece_id", number), ("at", at), ("start", start // 4), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", len(ids) // 4), ("ids", piece if with_ids else None)):
                        out[name].append(value)
                    number += 1
            columns = [pa.array(out["piece_id"], pa.int64()), batch.column("doc_id").take(pa.array(out["at"], pa.int64()))]
            columns += [pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
            names = ["piece_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return made


def pieces(docs: DataFrame, model: str, window: int = WINDOW, end_id: int = END_ID, specials_as_text: bool = True, with_ids: bool = False) -> DataFrame:
    """(piece_id, doc_id, start, length, ids_crc32, doc_tokens[, ids]): documents as pieces of at most `window` tokens, written.

    `model` is the text of a `tokenizers` file that drops white space. `ids` are little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(model)  # a vocabulary file, some MB whatever the corpus
    schema = f"piece_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return written(docs.select("doc_id", "text").mapInArrow(_pieces(told, window, end_id, specials_as_text, with_ids), schema))


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c says whether a window with room for c is open."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, room: int, value: int) -> None:
        i = room + self.leaves
        self.tree[i] = value
        while i > 1 and (i := i >> 1):
            now = self.tree[2 * i] | self.tree[2 * i + 1]
            if self.tree[i] == now:
                return
            self.tree[i] = now

    def add(self, window_id: int, room: int) -> None:
        self.by_room[room].append(window_id)
        if len(self.by_room[room]) == 1:
            self._mark(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out (window, room) with the least room that is `length` or more."""
        i = length + self.leaves
        while not self.tree[i]:  # up, to the right, until something is open
            while i & 1:
                i >>= 1
            if i < 1:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf
                return None
        while i < self.leaves:  # then down, to the left
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            self._mark(room, 0)
        return found, room


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window number, offset) of pieces given by descending length."""
    open_windows, opened, numbers, offsets = OpenWindows(window), 0, [], []
    for length in lengths:
        found = open_windows.tightest(length)
        number, room = found or (opened, window)
        opened += found is None
        numbers.append(number)
        offsets.append(window - room)
        if room > length:
            open_windows.add(number, room - length)
    return numbers, offsets


def _packed_group(window: int):
    def made(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "piece_id"], ascending=[False, True], kind="stable")
        numbers, offsets = best_fit(rows["length"].tolist(), window)
        return pd.DataFrame({"piece_id": rows["piece_id"], "sequence_id": (int(key[0]) << 32) + np.array(numbers, dtype=np.int64), "offset": np.array(offsets, dtype=np.int64)})

    return made


def layout(made: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(piece_id, sequence_id, offset) for pieces (piece_id, length)."""
    groups = max(1, -(-made.count() // group))
    dealt = made.select("piece_id", "length", F.pmod(F.xxhash64("piece_id"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(_packed_group(window), "piece_id long, sequence_id long, offset long")


def packed(docs: DataFrame, model: str, window: int = WINDOW, end_id: int = END_ID, specials_as_text: bool = True, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` its ids."""
    made = pieces(docs, model, window, end_id, specials_as_text, with_ids)
    return made.join(layout(made, window, group), "piece_id").drop("piece_id")


def sequences(docs: DataFrame, model: str, window: int = WINDOW, pad_id: int = 0, **how) -> DataFrame:
    """(sequence_id, n_tokens, ids): the windows themselves, as arrays of `window` ids, padded by `pad_id`."""

    def laid(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("offset")["ids"]), dtype="<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": rows["sequence_id"].iloc[:1].to_numpy(), "n_tokens": [len(ids)], "ids": [np.pad(ids, (0, window - len(ids)), constant_values=pad_id)]})

    rows = packed(docs, model, window, with_ids=True, **how).select("sequence_id", "offset", "ids")
    return rows.groupBy("sequence_id").applyInPandas(laid, "sequence_id long, n_tokens long, ids array<long>")


def public_model(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, public_model(), specials_as_text=False)
