"""Hard negatives against all pairs, in exact integers."""

import math
import random

import pytest

from pagelake.llm import hard_negatives
from tests.oracle import differences


def plain(rows, every=100, positives=5, most=10):
    own = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in own:
        if a[0] % every == 0:
            pairs = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in own if b[0] != a[0] and len(b[2]) == len(a[2]))
            for s, p, _ in [x for x in pairs if x[2] == a[1]][:positives]:
                fits = [(n, t) for t, n, label in pairs if label != a[1] and 30 * -s <= 100 * -t <= 90 * -s][:most]
                out += [(a[0], p, k, n, -s, -t) for k, (n, t) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label long, embedding array<double>, key string, part int").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mined(df, **how).collect())


@pytest.mark.parametrize("group_rows", [7, 65_536])
def test_every_triple(spark, group_rows):
    rng = random.Random(1)
    vector = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, rng.randint(0, 2), vector()) for i in range(-20, 180)]
    rows += [(1000 + i, 1, [0.5, 0.5, 0.5, 0.5]) for i in range(30)] + [(2000 + i, 2, [0.25, 0.5, 0.5, 0.5]) for i in range(30)]
    rows += [(5, 1, vector()), (10, 2, vector()), (10, 2, vector())]  # repeated ids, anchors too
    rows += [(3000, None, vector()), (None, 1, vector()), (3010, 1, None), (3020, 1, [1.0, None, 0.0, 0.0]), (3030, 1, [1.0, math.nan, 0.0, 0.0]), (3040, 1, [1.0, math.inf, 0.0, 0.0])]
    rows += [(3050 + i, i % 3, [0.5 * i, 1.0]) for i in range(20)] + [(4000 + i, i % 2, []) for i in range(0, 40, 5)] + [(4100, 0, [0.0] * 4)]
    got = mined(spark, rows, every=10, positives=3, most=4, group_rows=group_rows)
    assert got == plain(rows, 10, 3, 4) and len(got) > 100


def test_large_components(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 1), [rng.uniform(-3e5, 3e5) for _ in range(64)]) for i in range(60)]
    assert mined(spark, rows, every=10) == plain(rows, 10)
    assert mined(spark, [(i, i % 2, [1e200 if i % 3 else 1e-200] * 8) for i in range(40)], every=10)


def test_no_rows_and_no_pairs(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


def test_op11_equals_its_sql(spark):
    assert differences(spark, hard_negatives.op11, hard_negatives.OP11_SQL, "/root/testdata/sf0.01")[:3] == []
