"""Queries against their SQL on rows that only larger tables have, made here."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagelake.operators import index, outline, postings
from pagelake.plans import catalog, queries_search
from tests.oracle import TABLES, differences

SF = "/root/testdata/sf0.001"


def tables(folder, **made):
    """A folder of tables: those made, as {column: values}, and the smallest given ones."""
    for name in TABLES:
        if name in made:
            given = pq.read_schema(f"{SF}/{name}.parquet")
            pq.write_table(pa.table(made[name]).cast(given) if set(made[name]) == set(given.names) else pa.table(made[name]), folder / f"{name}.parquet")
        else:
            (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(folder)


def documents(rows):
    """`documents` of (doc_id, source, text)."""
    ids, sources, texts = zip(*rows)
    return {"doc_id": list(ids), "text": list(texts), "lang": ["en"] * len(ids), "source": list(sources), "n_chars": [len(t or "") for t in texts]}


def differing(spark, name, sf_dir):
    return differences(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir)[:3]


def test_citations_of_a_book_of_many_pages(spark, tmp_path):
    """A book of 9,010 pages: the 9,000th names page 0."""
    rows = documents([(i, "a", f"page number {i} of a long book") for i in range(9_010)])
    assert differing(spark, "citations_checked", tables(tmp_path, documents=rows)) == []


def test_own_text_of_digits(spark, tmp_path):
    """Texts that begin with more digits than their page takes of them."""
    rows = documents([(i, "a", f"{10**15 + i} and words" if i % 3 else f"{i} words and words") for i in range(80)])
    assert differing(spark, "page_text_sources", tables(tmp_path, documents=rows)) == []


def test_headings_that_begin_with_numbers(spark, tmp_path):
    """Addresses and dotted numbers at the beginning of lines of every size."""
    lines = ["56.187.231.175 Keit in lich auf", "1.2 Numbered words", "Another plain line of words", "3.4.5 deeper words", "plain words here", "12.13.14.15 words in large"]
    rows = documents([(i, "a", "\n".join(lines[i:] + lines[:i] + lines)) for i in range(6)])
    assert differing(spark, "headings_by_size", tables(tmp_path, documents=rows)) == []


@pytest.mark.parametrize("name", ["semantic_topk", "semantic_topk_of_model"])
def test_vectors_need_no_index(spark, monkeypatch, name):
    """Searches by vector alone don't wait for an index of the texts."""

    def none(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(queries_search, "of_table", none)
    assert differing(spark, name, SF) == []


@pytest.mark.parametrize("block", [3, 20_000])
def test_inherited_pages_in_one_pass(spark, monkeypatch, block):
    """Books of several blocks, one without any page, one null; no frame runs to a book's end from each row."""
    monkeypatch.setattr(outline, "BLOCK", block, raising=True)
    rng = random.Random(4)
    rows = [(b, o, rng.randint(1, 3), None if b == "none" else rng.choice([None, None, o * 3])) for b in ("a", "none", None) for o in range(60)]
    found = outline.inherited_pages(spark.createDataFrame(rows, "book_id string, ord long, level int, page long"))
    wanted = set()
    for b, o, level, page in rows:
        own = [(n, p) for c, n, _, p in rows if c == b and p is not None]
        back, ahead = ([p for n, p in own if n <= o][-1:] + [None])[0], ([p for n, p in own if n >= o] + [None])[0]
        wanted.add((b, o, level, page if page is not None else (ahead if ahead is not None else back) if level == 1 else (back if back is not None else ahead)))
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(rows)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize(("part", "cells"), [(1, 1 << 27), (16 << 20, 0)])
def test_postings_of_parts(part, cells, monkeypatch):
    """Blocks of parts of one batch each, or of all: words with places, runs and short ones of pages of several books and ranges, signs beyond 16 bits, null and empty texts."""
    monkeypatch.setattr(postings, "PART", part)
    monkeypatch.setattr(postings, "CELLS", cells)
    rng = random.Random(5)
    rows = [(b, p // 20, p, rng.choice([None, "", "  "]) if p % 7 == 0 else "  ".join(rng.choices(["é", "ab", "abc", "日本", "\U0001f600x", "abab"], k=rng.randint(1, 12)))) for b in ("a", None) for p in range(50)]
    rng.shuffle(rows)
    names = ["book_id", "range", "page", "text", "words", "dl"]
    table = pa.table({n: v for n, v in zip(names, zip(*[(*r, None, None) if r[3] is None else (*r, r[3].split(), len(r[3].split())) for r in rows]))}, schema=pa.schema([("book_id", pa.string()), ("range", pa.int64()), ("page", pa.int32()), ("text", pa.string()), ("words", pa.list_(pa.string())), ("dl", pa.int32())]))
    batches = table.to_batches(max_chunksize=17)
    words, runs, short = ([r for b in made(iter(batches)) for r in b.to_pylist()] for made in (postings.word_blocks(index.impact, 4.5, index.TIERS), postings.run_blocks(), postings.run_blocks(True)))
    got = [(r["token"], r["book_id"], r["range"], p, tf, dl, tuple(r["places"][at : at + tf])) for r in words for p, tf, dl, at in zip(r["pages"], r["tfs"], r["dls"], r["firsts"])]
    wanted = {(w, b, g, p, t.split().count(w), len(t.split()), tuple(i for i, x in enumerate(t.split()) if x == w)) for b, g, p, t in rows if t for w in t.split()}
    assert set(got) == wanted and len(got) == len(wanted) == sum(r["n"] for r in words)
    for r in words:
        each = [index.impact(tf, dl, 4.5) for tf, dl in zip(r["tfs"], r["dls"])]
        assert (min(each), max(each)) == (r["least"], r["best"]) and {int(x * index.TIERS) for x in each} == {r["tier"]}
    for found, parts in ((runs, str.split), (short, lambda t: {x[i : i + k] for x in t.split() for i in range(len(x)) for k in (1, 2)})):
        pages = [(r["run"], r["book_id"], r["range"], p) for r in found for p in r["pages"]]
        wanted = {(x, b, g, p) for b, g, p, t in rows if t for x in parts(t)}
        assert set(pages) == wanted and len(pages) == len(wanted) == sum(r["n"] for r in found) and all(r["pages"] == sorted(r["pages"]) for r in found)
    if part > 1:
        assert len(words) == len({(r["token"], r["book_id"], r["range"], r["tier"]) for r in words})
