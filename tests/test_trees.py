"""Trees against plain stacks, across blocks, at any depth; places in a whole order."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import headings, library, outline, trees


@pytest.mark.parametrize("block", [3, 20_000])
def test_levels_nest(spark, monkeypatch, block):
    monkeypatch.setattr(trees, "BLOCK", block)
    rng = random.Random(1)
    rows = [(b, o, f"{b}{o}", rng.choice([1, 2, 3, 5, 9, 0])) for b in ("a", "b", None) for o in sorted(rng.sample(range(200), 60))]
    want = {}
    for b in ("a", "b", None):
        stack = []
        for _, o, _, level in [r for r in rows if r[0] == b]:
            del stack[max(0, level - 1) :]
            want[b, o] = (stack[-1] if stack else None, len(stack) + 1)
            stack.append(o)
    found = outline.level_tree(spark.createDataFrame(rows, "book_id string, ord long, label string, level int")).collect()
    assert {(r["book_id"], r["ord"]): (r["parent"], r["depth"]) for r in found} == want and len(found) == len(rows)


@pytest.mark.parametrize("block", [4, 20_000])
def test_paths_of_any_depth(spark, monkeypatch, block):
    monkeypatch.setattr(trees, "BLOCK", block)
    rng = random.Random(2)
    nodes = [("a", o, o + 1 if o < 14 else rng.randint(1, 14), f"n{o}", o) for o in range(60)] + [(None, 0, 3, "x", 1), (None, 1, 4, None, 2)]
    found = headings.paths(spark.createDataFrame(nodes, "book_id string, ord long, depth int, label string, page long")).collect()
    want, stack = {}, []
    for _, o, d, label, _ in nodes[:60]:
        while stack and stack[-1][0] >= d:
            stack.pop()
        stack.append((d, label))
        want["a", o] = [x for _, x in stack]
    assert {(r["book_id"], r["ord"]): r["path"] for r in found} == want | {(None, 0): ["x"], (None, 1): ["x"]}


def test_circles_and_orphans_go(spark):
    rows = [("a", 1, None), ("a", 2, 1), ("a", 3, 4), ("a", 4, 3), ("a", 5, 99), ("a", 6, 5), ("a", 7, 7), ("a", 8, 3)] + [("b", i, i - 1 if i else None) for i in range(100)]
    df = spark.createDataFrame(rows, "book_id string, id long, parent long")
    found = {(r["book_id"], r["id"]): len(r["lineage"]) for r in trees.lineages(df, "id", "parent", F.col("id")).collect()}
    assert found == {("a", 1): 1, ("a", 2): 2} | {("b", i): i + 1 for i in range(100)}
    assert trees.lineages(df.where("false"), "id", "parent", F.col("id")).count() == 0


def test_places_in_the_whole_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 5), rng.random() < 0.8) for i in range(500)]
    books = spark.createDataFrame(rows, "book_id long, updated_at long, in_library boolean").repartition(5)
    order = [i for i, u, s in sorted(rows, key=lambda r: (-r[1], r[0])) if s]
    assert [r["book_id"] for r in library.shelf(books).orderBy("place").collect()] == order
    assert [(r["place"], r["book_id"]) for r in library.shelf(books, 1).collect()] == [(1, order[0])]
    assert library.shelf(books.where("false")).count() == 0
