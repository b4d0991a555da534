"""Rules of chunks, headings, outlines and citations on small rows, each against a stated or a plain result."""

import random
import re

from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.operators import chunker, citations, headings, index, matching, outline, search


def column(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_cost(text):
    return -(-sum(4 if re.match(T.CJK, c) else 1 for c in text) // 4)


def plain_places(text):
    places = []
    for m in re.finditer(r"\n\n", text):
        places.append((4, m.start()))
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line:
            bare = line.strip()
            head = len(bare) <= 80 and re.match(r"第[一二三四五六七八九十百零〇0-9]+[章节篇部]|chapter\s+\w|\d+(\.\d+){0,3}\s+\S", bare, re.I | re.A)
            places += [(5, at), (3, end)] if head else [(2, end)]
        at = end + 1
    places += [(1, i + 1) for i, c in enumerate(text) if c in "。！？!?；;" or c == "." and (i + 1 == len(text) or text[i + 1].isspace())]
    return [(p, x) for p, x in places if 0 < x]


def plain_chunks(text):
    if plain_cost(text) <= 800:
        return [text] if text else []
    places, out, start = plain_places(text), [], 0
    while start < len(text):
        near = range(start + 1, min(len(text), start + 4 * 800) + 1)
        cost, spent = {}, 0
        for e in near:
            spent += 4 if re.match(T.CJK, text[e - 1]) else 1
            cost[e] = -(-spent // 4)
        if cost.get(len(text), 801) <= 800:
            out.append(text[start:].strip())
            break
        least, end = (max(e for e in near if cost[e] <= budget) for budget in (500, 800))
        end = max([(p, x) for p, x in places if least <= x <= end], default=(0, end))[1]
        out.append(text[start:end].strip())
        back = end
        while back > 0 and plain_cost(text[back - 1 : end]) <= 96:
            back -= 1
        start = back if back > start else end
    return [c for c in out if c]


def test_chunks_equal_plain_ones():
    rng = random.Random(7)
    parts = ["word ", "字字字。", "End. ", "\n", "\n\n", "Chapter 3 On\n", "\n2.1 Ways\n", "第三章 能量\n", "a;b", "x" * 90, "3.5"]
    for size in (300, 700, 1100):
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(rng.choice(parts) for _ in range(size)))).strip()
        assert chunker.chunks(text) == plain_chunks(text) and len(plain_chunks(text)) > 1


def test_headings_by_words(spark):
    assert column(spark, T.looks_like_heading, "第三章 x", "chapter one", " 1.2 A", "1.2.3.4.5 A", "Part 2", "3.A", "9 " + "x" * 90, None) == [True, True, True, False, False, False, False, None]


def test_html_rules(spark):
    assert column(spark, T.stripped_html, 'a<b class="x">c</b>d<br>e', "<>x", None) == ["acd e", "<>x", None]
    found = column(spark, T.decoded_entities, "&amp;lt; &#65;&#x42;&AMP;&apos; &hellip; & &unknown; &#x110000;", "plain", "", None)
    assert found == ["&lt; AB&' ... & &unknown; &#x110000;", "plain", "", None]


def test_export_names(spark):
    name = lambda x: T.export_name(x, F.lit("2024-02-01").cast("date"))
    assert column(spark, name, ' A:  "b"? ..', "...", "x" * 79 + ". y", None) == ["A b-conversation-20240201.md", "untitled-conversation-20240201.md", "x" * 79 + "-conversation-20240201.md", "untitled-conversation-20240201.md"]


def test_title_keys(spark):
    assert column(spark, outline.title_key, "1 窃读记", "窃(qiè)读记", "Chapter IV  The Sea", "2.3 Waves!", "第十二章 电", "Appendix", "7") == ["窃读记", "窃读记", "thesea", "waves", None, "appendix", None]


def test_ordinals(spark):
    found = column(spark, headings.ordinal, "第十二章 x", "第3节", "Appendix IV", "section 2", "1.2 x", "1.2.3 x", "Part x", "plain")
    assert [o and (o["type"], o["number"], o["scope"]) for o in found] == [("chapter", 12, None), ("section", 3, None), ("chapter", 4, None), ("section", 2, None), ("section", 2, 1), None, ("chapter", 10, None), None]


def test_running_heads(spark):
    labels = ["Chapter 1 A", "section 1 x", "Notes", "Chapter 1 A", "Chapter 2 B", "section 1 y", "Notes", "section 1 x", "Notes", "1.1 z", "Twice", "Twice"]
    rows = spark.createDataFrame([("b", i, i + 1, x) for i, x in enumerate(labels)], "book_id string, ord long, page int, label string")
    assert [r["ord"] for r in headings.first_of_each(rows).orderBy("ord").collect()] == [0, 1, 2, 4, 5, 10, 11]


def test_embedded_gate(spark):
    books = {
        "real": [("One", 1), ("Two", 5), ("Three", 5)], "half": [("a", 1), ("b", None), ("c", 9), ("d", 99)], "doubled": [("a", 1), ("b", 2), ("c", 3), ("d", 3), ("e", 4), ("f", 5)],
        "two": [("a", 1), ("b", 2)], "quarter": [("a", 1), ("b", None), ("c", None), ("d", 0)], "one page": [("a", 4), ("b", 4), ("c", 4)], "alike": [("x", 1), ("x ", 2), ("x", 9)],
        "unnamed": [("未命名目录 1", 1), ("未命名目录 2", 3), ("未命名目录 3", 7)], "numbers": [("1", 1), ("2", 3), ("3", 9)], "every page": [(f"p{i}", i) for i in range(1, 6)], "blank": [(" ", 1), (None, 3), ("", 9)],
    }
    totals = spark.createDataFrame([(b, 5 if b in ("every page", "doubled") else 10) for b in books], "book_id string, total long")
    nodes = spark.createDataFrame([(b, i, 1, x, p) for b, rows in books.items() for i, (x, p) in enumerate(rows)], "book_id string, ord long, depth int, label string, page long")
    assert {r["book_id"] for r in outline.embedded_gate(nodes, totals).where("accepted").collect()} == {"real", "half", "doubled"}


def test_monotone_pages(spark):
    nodes = spark.createDataFrame([("b", i, p) for i, p in enumerate([50, 30, None, 60])], "book_id string, ord long, page long")
    assert [r["page"] for r in outline.monotone(nodes).orderBy("ord").collect()] == [50, 50, None, 60]


def test_sections_without_pages(spark):
    # A node without a page starts at its child's; a sibling without one doesn't end the node before it.
    rows = [("p", 0, 1, None), ("p", 1, 2, 7), ("p", 2, 1, 9), ("s", 0, 1, 10), ("s", 1, 1, None), ("s", 2, 1, 30), ("r", 0, 1, 41)]
    nodes = spark.createDataFrame(rows, "book_id string, ord long, depth int, page long")
    totals = spark.createDataFrame([("p", 12), ("s", 40), ("r", 41)], "book_id string, total long")
    found = {(r["book_id"], r["ord"]): (r["start"], r["end"]) for r in outline.section_ranges(nodes, totals).collect()}
    assert found == {("p", 0): (7, 8), ("p", 1): (7, 8), ("p", 2): (9, 12), ("s", 0): (10, 29), ("s", 2): (30, 40), ("r", 0): (41, 41)}


def test_chapters_and_paths(spark):
    nodes = spark.createDataFrame([("b", 0, 1, "I", 120), ("b", 1, 2, "a", 140), ("b", 2, 3, "x", 146), ("b", 3, 1, "II", 200)], "book_id string, ord long, depth int, label string, page long")
    pages = spark.createDataFrame([("b", p) for p in (147, 143, 210, 3)], "book_id string, page long")
    found = {r["page"]: r["path"] for r in headings.section_paths(pages, nodes).collect()}
    assert found == {147: "I › a › x", 143: "I › a", 210: "II", 3: None}
    chapters = outline.chapter_ranges(spark.createDataFrame([("b", i, 1, "c", p) for i, p in enumerate((3, 40, 120))], "book_id string, ord long, depth int, label string, page long"), spark.createDataFrame([("b", 200)], "book_id string, total long"))
    assert sorted((r["start"], r["end"]) for r in chapters.collect()) == [(3, 39), (40, 119), (120, 200)]


def test_heading_candidates(spark):
    lines = [("Chapter One Energy", 24.0), ("plain text of a body line", 12.0), ("another body line here", 12.0), ("third line of the body", 12.0), ("1.2 Numbered", 16.0), ("12", 30.0), ("a, b;", 24.0), ("Page 3 of 9", 24.0)]
    rows = spark.createDataFrame([(1, i, x, s) for i, (x, s) in enumerate(lines)], "page_id int, ord int, text string, size double")
    assert {(r["ord"], r["level"]) for r in headings.candidates(rows).collect()} == {(0, 1), (4, 2)}


ANSWERS, EVIDENCE, PAGES = "answer_id int, book_id string, body string", "answer_id int, page int", "book_id string, page int, text string"


def checked(spark, answers, evidence, pages):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((answers, ANSWERS), (evidence, EVIDENCE), (pages, PAGES))]
    return sorted((r["answer_id"], r["kind"], r["page"], r["excerpt"]) for r in citations.checked(*frames).collect())


def test_page_claims(spark):
    answer = [(1, "b", "第3页，第 7 页、第12 页，第 7 页"), (2, "empty", "第 5 页 “nowhere at all”"), (3, "b", None)]
    assert checked(spark, answer, [(1, 3)], [("b", 12, "text of twelve")]) == [(1, "page_claim_unindexed", 7, "第 7 页")]


def test_quotes(spark):
    absent = "z" * 100
    answer = [(1, "b", f"第 4 页：“the quick, brown fox” 「{absent}」 \"tiny\" 《Jumps over THE dog》"), (2, "b", "第 9 页 “the quick brown fox”"), (3, "b", "“the lazy-dog”"), (4, "b", "“the lazy-dog”")]
    pages = [("b", 4, "The quick\nbrown FOX; jumps over the dog"), ("b", 5, "the lazy dog"), ("other", 4, absent)]
    assert checked(spark, answer, [(3, 5), (4, 4)], pages) == [(1, "quote_not_found", None, "z" * 60 + "…"), (2, "page_claim_unindexed", 9, "第 9 页"), (4, "quote_not_found", None, "the lazy-dog")]


def test_grounded_quotes(spark):
    quotes = spark.createDataFrame([(1, "Brown fox"), (2, "no such"), (3, "...  "), (4, "BROWN-fox"), (5, None), (6, "own f")], "quote_id int, quote string")
    pages = spark.createDataFrame([(1, "a brown, fox; brown fox"), (2, "brownfox"), (3, None), (4, "")], "page_id int, text string")
    expected = {1: (2, 1), 2: (0, None), 3: (0, None), 4: (2, 1), 5: (0, None), 6: (2, 1)}
    assert {r["quote_id"]: (r["n_pages"], r["first_page_id"]) for r in citations.grounded(quotes, pages).collect()} == expected
    assert citations.grounded(quotes.where("quote_id = 3"), pages).collect()[0]["n_pages"] == 0


def test_strings_in_texts(spark):
    """Strings of every length about the bounds of fingerprints, at any place, with characters beyond 16 bits."""
    rng = random.Random(6)
    signs = "abcé日\U0001f600"
    texts = ["".join(rng.choices(signs, k=rng.choice([0, 3, 14, 15, 16, 40, 200]))) for _ in range(60)] + ["ab" * 50, "ab" * 50, None]
    forms = {t[i : i + n] for t in texts if t for n in (1, 2, 7, 8, 13, 14, 15, 16, 30) for i in [rng.randrange(max(1, len(t)))] if t[i : i + n]}
    forms |= {"ab" * 7, "ab" * 8, "zz", "z" * 15, "".join(rng.choices(signs, k=20))}
    rows = spark.createDataFrame([(i % 40, t, "x") for i, t in enumerate(texts)], "id int, m string, row string").repartition(3)
    found = matching.containing(rows, spark.createDataFrame([(f,) for f in [*forms, *forms]] + [(None,), ("",)], "q string")).collect()
    assert sorted((r["id"], r["q"]) for r in found) == sorted((i % 40, f) for i, t in enumerate(texts) if t for f in forms if f in t) and found[0]["row"] == "x"


def test_hybrid_and_focus(spark):
    texts = ["energy is conserved " * 8, "other matters " * 10, "energy is conserved " * 8]
    pages = spark.createDataFrame([("b", i + 1, i, t) for i, t in enumerate(texts)], "book_id string, page int, doc_id long, text string")
    chunks = pages.withColumn("factor", F.lit(1.0)).withColumn("vector", F.when(F.col("text").contains("energy"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    queries = spark.createDataFrame([(1, "energy")], "query_id int, query string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    made = index.built(pages)
    focus = lambda a, b: spark.createDataFrame([(1, "b", None, 2, a, b)], "query_id int, book_id string, selected_page int, current_page int, chapter_from int, chapter_to int")
    first = lambda f: [r["page"] for r in search.hybrid_search(made, chunks, queries, vectors, f).where("rank = 1 AND mode = 'hybrid'").collect()]
    assert first(None) == [1] and first(focus(None, None)) == [1] and first(focus(3, 3)) == [3]
