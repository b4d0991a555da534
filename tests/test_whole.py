"""Queries without a cap, on more rows than the caps of their older forms, and windows that cross blocks."""

import random

import pytest

from pagelake.operators import headings, outline
from pagelake.plans import catalog
from pagelake.sources import tables
from tests.oracle import differences


@pytest.mark.parametrize("name", ["section_range_whole", "paged_reading_whole"])
def test_every_row_counts(spark, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], "/root/testdata/sf0.01")[:3] == []


def plain_sections(nodes, total):
    def past(rows, i):
        return next((j for j in range(i + 1, len(rows)) if rows[j][1] <= rows[i][1]), len(rows))

    found = [(o, d, next((p for _, _, p in nodes[i : past(nodes, i)] if p is not None), None)) for i, (o, d, _) in enumerate(nodes)]
    found = [r for r in found if r[2] is not None]
    ends = [found[past(found, i)][2] - 1 if past(found, i) < len(found) else total for i in range(len(found))]
    return {o: (s, max(s, e)) for (o, _, s), e in zip(found, ends)}


@pytest.mark.parametrize("block", [3, 20_000])
def test_sections_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(outline, "BLOCK", block, raising=True)
    rng = random.Random(1)
    nodes = [(o, rng.randint(1, 4), rng.choice([None, None, 3 * o + 1])) for o in range(400)]
    df = spark.createDataFrame([("b", *n) for n in nodes], "book_id string, ord long, depth int, page long")
    got = outline.section_ranges(df, spark.createDataFrame([("b", 2000)], "book_id string, total long")).collect()
    assert {r["ord"]: (r["start"], r["end"]) for r in got} == plain_sections(nodes, 2000) and len(got) == len({r["ord"] for r in got})


def test_sections_join_no_pairs(spark):
    nodes = spark.range(60_000).selectExpr("'b' AS book_id", "id AS ord", "cast(1 + id AS int) % 3 AS depth", "id AS page")
    plan = outline.section_ranges(nodes, spark.createDataFrame([("b", 60_000)], "book_id string, total long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ord" in plan and not [line for line in plan.splitlines() if "Join" in line and (">" in line.replace("<=>", "") or " < " in line)]


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_pages_across_blocks(spark, monkeypatch, block):
    """Pages as one window a source would number them: sparse, negative and null ids, a null source, an empty table."""
    monkeypatch.setattr(tables, "PAGE_BLOCK", block, raising=True)
    rng = random.Random(2)
    ids = rng.sample(range(-300, 3000), 200)
    rows = [(i, rng.choice(["a", "a", "b", None]), f"t{i}", "x") for i in ids] + [(None, "a", "none", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, before string")
    got = {(r["book_id"], r["doc_id"]): (r["page"], r["text"]) for r in tables.book_pages(docs).collect()}
    wanted = {}
    for source in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0))
        wanted |= {(source, r[0]): (n, r[2]) for n, r in enumerate(own, 1)}
    assert got == wanted
    assert tables.book_pages(docs.limit(0)).columns == ["book_id", "page", "doc_id", "text"] and not tables.book_pages(docs.limit(0)).count()


def test_outline_of_each_tier(spark):
    schema = "book_id string, accepted boolean, native_majority boolean, total long, blocks long, processed long, toc_rows long, page_offset long, body_roots long"
    books = [("marks", True, None, 9, None, None, None, None, None), ("own", False, True, 9, 0, 9, 4, 2, 5), ("scan", None, False, 9, 9, 9, 4, None, 5), ("none", None, None, None, None, None, None, None, None)]
    decided = headings.tiers(spark.createDataFrame(books, schema))
    assert {r["book_id"]: (r["strategy"], r["status"], r["calibrated"]) for r in decided.collect()} == {
        "marks": ("embedded", "embedded", True), "own": ("ai_toc", "generated", True), "scan": ("body_headings", "generated", True), "none": (None, "partial", None)}
    nodes = spark.createDataFrame([(b, s, f"{b} {s}") for b, *_ in books for s in ("embedded", "ai_toc", "body_headings")], "book_id string, strategy string, label string")
    assert sorted(r["label"] for r in headings.rebuilt(decided, nodes).collect()) == ["marks embedded", "own ai_toc", "scan body_headings"]
