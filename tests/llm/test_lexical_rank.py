"""Ranked search against scoring every document for every item, in exact integers."""

import math
import random
import re
from collections import Counter

import pytest

from pagelake.llm import lexical_rank
from tests.oracle import differences


def plain(docs, items, most=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        rows = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 8 * m)) for w in set(words(text)) if b[w])
            if score:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:most], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **how):
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, n int").repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    return sorted([tuple(r) for r in lexical_rank.ranked(left, right, **how).collect()], key=str)


@pytest.mark.parametrize("how", [{}, {"block_terms": 20}, {"slice_items": 2}])
def test_every_rank(spark, how):
    rng = random.Random(4)
    pool = "Alpha beta gAmma été 日本 x1 the the the of of ñandú 42 _ - ÀB".split(" ")
    docs = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 30])))) for i in range(-50, 150)]
    docs += [(1000 + i, "Alpha, beta; alpha") for i in range(60)] + [(500 + i, "beta ALPHA alpha!") for i in range(60)]
    docs += [(None, "alpha beta alpha"), (7, "alpha beta alpha"), (7, "alpha beta alpha"), (2000, None), (2001, ""), (2002, "_ - !"), (2003, "alpha " * 5_000)]
    items = [(0, "alpha beta"), (1, "Alpha alpha ALPHA"), (2, None), (3, ""), (4, "nowhere"), (5, "the of été"), (6, "42 日本 _"), (6, "x1"), (7, "àb ÀB"), (8, " ".join(pool))]
    got = ranked(spark, docs, items, **how)
    assert got == plain(docs, items) and len(got) > 50


def test_empty_tables(spark):
    some = [(1, "a b")]
    assert ranked(spark, [], some) == ranked(spark, some, []) == ranked(spark, [(1, None)], some) == []


def test_hot_bags_are_cut_before_the_shuffle(spark):
    found = spark.createDataFrame([(1, 2, [0], [1])], "doc_id long, n long, terms array<int>, tfs array<int>")
    assert "WindowGroupLimit" in lexical_rank.classes(found, 1, 2)._jdf.queryExecution().executedPlan().toString()


def test_op12_equals_its_sql(spark):
    assert differences(spark, lexical_rank.op12, lexical_rank.OP12_SQL, "/root/testdata/sf0.01")[:3] == []
