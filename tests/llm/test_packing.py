"""Packing against plain versions: whole texts encoded, pieces cut, windows filled, the tightest window always taken."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelake.llm import packing

MODEL = packing.public_model()
ODD = ["don't can'T 'S x's", "a!'s!t", "Ångström ÀÉß ÷×", "éa ́ x́!!", "１２ Ⅷ 12ab34", "日本語テキスト、です。", "a b c\x1cd\x85e", "łódź İI", "<|endoftext|> a<|endoftext|>b", "!!!???...", "\U0001f600‍\U0001f600 x", "", "  ", "ﬁ ﻿", "µm ªº"]


@pytest.mark.parametrize("as_text", [True, False])
def test_ids_are_those_of_whole_texts(as_text):
    whole = Tokenizer.from_str(MODEL)
    whole.encode_special_tokens = as_text
    encoder = packing.Encoder(MODEL, as_text)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices(" ".join(ODD).split(" "), k=30)) for _ in range(100)] + ["x" * 5_000, "A" * 60]
    assert encoder.by_word
    for text in texts * 2:
        assert np.frombuffer(encoder.encoded(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    encoder = packing.encoder(MODEL)
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encoded(text), "<u4").tolist() == whole


@pytest.mark.parametrize("window", [1, 8, 37, 4096])
def test_the_tightest_window_is_taken(window):
    rng = random.Random(window)
    lengths = sorted((rng.randint(1, window) for _ in range(1500)), reverse=True)
    numbers, offsets = packing.best_fit(lengths, window)
    rooms: list[int] = []
    for length, number, offset in zip(lengths, numbers, offsets):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            assert rooms[number] == min(fitting)
        else:
            assert number == len(rooms)
            rooms.append(window)
        assert offset == window - rooms[number]
        rooms[number] -= length


def plain_pieces(texts, window, end=2):
    whole = Tokenizer.from_str(MODEL)
    whole.encode_special_tokens = True
    for doc, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, end]
        for start in range(0, len(ids), window):
            piece = ids[start : start + window]
            yield doc, start, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), len(ids)


def gapless(rows, window):
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(0 < e <= window for e in ends.values())
    return ends


@pytest.mark.parametrize("group", [7, 16_384])
def test_pieces_and_windows(spark, group):
    rng = random.Random(5)
    words = "the Harbour's boats, (lay) at anchor in 1912!! élan".split()
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(60)]
    texts += [(None, "no id"), (None, "no id"), (7, "an id again"), (100, None), (101, ""), (102, " ".join(words) * 300)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, ids string, piece_id int").repartition(3)
    rows = packing.packed(docs, MODEL, window=64, group=group).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows], key=str) == sorted(plain_pieces(texts, 64), key=str), key
    ends = gapless(rows, 64)
    if group > 60:
        assert sum(1 for e in ends.values() if e < 60) <= 2


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four " * 50), (3, None)], "doc_id long, text string")
    pieces = packing.packed(docs, MODEL, window=16, with_ids=True).collect()
    rows = {r["sequence_id"]: r for r in packing.sequences(docs, MODEL, window=16, pad_id=9).collect()}
    for r in pieces:
        held = rows[r["sequence_id"]]["ids"]
        assert held[r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4").tolist() and len(held) == 16
    assert all(r["ids"][r["n_tokens"] :] == [9] * (16 - r["n_tokens"]) for r in rows.values())


def test_empty_table_and_whole_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(none, MODEL).collect() == [] and packing.sequences(none, MODEL).collect() == []
    rows = packing.op13(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(plain_pieces([tuple(d) for d in docs], 4096))
    ends = gapless(rows, 4096)
    assert sum(4096 - e for e in ends.values()) <= 4096
