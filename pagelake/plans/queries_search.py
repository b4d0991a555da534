"""Search and text queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunker, citations, search, state, vectors
from ..operators.index import built, of_table
from ..sources.tables import book_pages, few, table

#: Characters of a part in offset reading.
PART = 20_000

PAGES = "pages_ AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, doc_id, text FROM documents)"
QUERIES_CTE = "queries_ AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TERMS = r"list_filter(string_split_regex(query, '[\s,，、;；:：/|]+'), lambda t: t <> '')"
REPLACED = "pages_ AS (SELECT book_id, page, doc_id, CASE WHEN doc_id % 7 = 0 THEN substring(text, 1, 200) || ' quillon ' || doc_id % 5 ELSE text END AS text FROM (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, doc_id, text FROM documents) WHERE doc_id % 11 <> 0)"
REPLACED_QUERIES = "queries_ AS (SELECT item_id AS query_id, 'quillon ' || substring(text, 1, 40) AS query FROM benchmark)"
BLANK_QUERIES = "queries_ AS (SELECT item_id AS query_id, CASE WHEN item_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS query FROM benchmark)"
CJK = r"[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]"
TOKENS = rf"regexp_extract_all(strip_accents(lower(trim(regexp_replace(regexp_replace({{0}}, '({CJK})', ' \1 ', 'g'), '\s+', ' ', 'g')))), '[\p{{L}}\p{{N}}]+')"


def _tokens(x: str) -> str:
    return TOKENS.replace("{0}", x)


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


FACTOR = r"(CASE WHEN {e} >= 120 THEN 1.0 ELSE greatest(0.4, {e} / 120.0) END)".format(e=r"greatest(0, length({0}) - 3 * coalesce(list_sum(list_transform(regexp_extract_all({0}, '[.．·・…‥]{{3,}}'), lambda r: length(r))), 0))")

LEXICAL = rf"""
{PAGES},
{QUERIES_CTE},
terms_ AS (SELECT DISTINCT query_id, unnest({_distinct(TERMS)}[1:8]) AS term, len({_distinct(TERMS)}[1:8]) AS terms FROM queries_),
words_ AS (SELECT book_id, page, unnest(w) AS token, unnest(range(len(w))) AS pos, len(w) AS dl FROM (SELECT book_id, page, {_tokens('text')} AS w FROM pages_)),
wanted_ AS (SELECT query_id, term, len(w) AS n, unnest(w) AS token, unnest(range(len(w))) AS i FROM (SELECT query_id, term, {_tokens('term')} AS w FROM terms_)),
found_ AS (SELECT query_id, term, n, book_id, page, pos - i AS start FROM words_ JOIN wanted_ USING (token) GROUP BY ALL HAVING count(*) = n),
tf_ AS (SELECT query_id, term, book_id, page, count(*) AS tf FROM found_ GROUP BY ALL),
sizes_ AS (SELECT book_id, page, len({_tokens('text')}) AS dl FROM pages_),
whole_ AS (SELECT count(*) AS pages, avg(dl) AS avg_dl FROM sizes_),
bm_ AS (SELECT tf_.*, round(greatest(1e-6, ln((pages - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl)), 9) AS bm25
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM tf_) tf_ JOIN sizes_ USING (book_id, page), whole_),
phrase_ AS (SELECT * FROM bm_ QUALIFY row_number() OVER (PARTITION BY query_id, term, book_id ORDER BY bm25 DESC, page) <= 40),
like_ AS (SELECT query_id, book_id, page FROM (SELECT DISTINCT query_id, book_id, page FROM pages_ p JOIN terms_ t ON contains(lower(p.text), lower(t.term)))
  QUALIFY row_number() OVER (PARTITION BY query_id, book_id ORDER BY page) <= 40),
every_ AS (SELECT query_id, book_id, page, max(hits) AS hits FROM (
  SELECT query_id, book_id, page, count(DISTINCT term) AS hits FROM phrase_ GROUP BY ALL UNION ALL SELECT query_id, book_id, page, 0 FROM like_) GROUP BY ALL),
lexical_ AS (SELECT query_id, book_id, page, CASE WHEN hits > 0 THEN 0.5 + 0.5 * (hits / greatest(1, max(hits) OVER (PARTITION BY query_id, book_id))) WHEN terms <= 1 THEN 1.0 ELSE 0.6 END AS lexical
  FROM every_ JOIN (SELECT DISTINCT query_id, terms FROM terms_) USING (query_id))"""
SEMANTIC = f"""
semantic_ AS (SELECT b.item_id AS query_id, p.book_id, p.page, max(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))) * {FACTOR.format('p.text')}) AS semantic
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e JOIN pages_ p ON p.doc_id = e.vec_id GROUP BY ALL)"""
SEMANTIC_OF_MODEL = SEMANTIC.replace("GROUP BY ALL", "WHERE q.label % 2 = e.label % 2 AND e.vec_id % 10 <> 9 GROUP BY ALL")
FUSED = """
fused_ AS (SELECT query_id, book_id, page, coalesce(lexical, 0) AS lexical, coalesce(semantic, 0) AS semantic FROM lexical_ FULL OUTER JOIN semantic_ USING (query_id, book_id, page)),
mode_ AS (SELECT *, max(semantic) OVER (PARTITION BY query_id, book_id) > 0 AS hybrid FROM fused_),
base_ AS (SELECT *, CASE WHEN hybrid THEN 0.65 * semantic + 0.35 * lexical ELSE lexical END AS base FROM mode_)"""
SNIPPET = "CASE WHEN loc > 0 THEN (CASE WHEN greatest(0, loc - 61) > 0 THEN '…' ELSE '' END) || substring(text, greatest(0, loc - 61) + 1, least(length(text), loc - 1 + length(q) + 100) - greatest(0, loc - 61)) || (CASE WHEN least(length(text), loc - 1 + length(q) + 100) < length(text) THEN '…' ELSE '' END) ELSE left(text, 160) END"


def _ranked(boost: str = "0.0", joined: str = "base_") -> str:
    return f"""
top_ AS (SELECT * FROM (SELECT query_id, book_id, page, round(base + {boost}, 6) AS score, CASE WHEN hybrid THEN 'hybrid' ELSE 'fts-only' END AS mode FROM {joined}) WHERE score > 0),
rank_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, book_id ORDER BY score DESC, page) AS rank FROM top_ QUALIFY rank <= 6),
hits_ AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id, book_id) AS best FROM rank_) WHERE best <= 0 OR score >= best * 0.6)"""


def _queries(spark, sf_dir):
    """Whole benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, sf_dir, pages):
    """The vectors of pages (doc_id, book_id, page, factor), and those of the queries."""
    embeddings = table(spark, sf_dir, "embeddings")
    chunks = embeddings.join(pages.select("doc_id", "book_id", "page", "factor"), F.col("vec_id") == F.col("doc_id")).select("book_id", "page", "factor", F.col("embedding").alias("vector"), "vec_id", "label")
    asked = embeddings.join(few(_queries(spark, sf_dir).select("query_id")), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"), "label")
    return chunks, asked


def _index(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return of_table(documents, book_pages(documents))


def inputs(spark, sf_dir):
    """The index of all pages, their vectors, and whole benchmark texts as queries with their vectors."""
    index = _index(spark, sf_dir)
    chunks, asked = _vectors(spark, sf_dir, index.pages())
    return index, chunks, _queries(spark, sf_dir), asked


def _vectors_alone(spark, sf_dir):
    """As `inputs`, without an index: a page's number and the trust in its text are all that vectors ask of the documents."""
    trusted = table(spark, sf_dir, "documents").select("doc_id", "source", T.length_factor(F.col("text")).alias("factor"))
    return _vectors(spark, sf_dir, book_pages(trusted, "factor"))


def index_postings(spark, sf_dir):
    """What the index holds of each book: pages, words, pages by word and pages by run, as its blocks count them."""
    index = _index(spark, sf_dir)
    pages = index.live().groupBy("book_id").agg(F.sum("pages").alias("pages"), F.sum("words").alias("words"))
    by_word = index.table("words").groupBy("book_id").agg(F.sum("n").alias("word_pages"), F.sum(F.aggregate("at", F.lit(0), lambda a, p: a + p["tf"])).alias("places"))
    by_run = index.table("runs").groupBy("book_id").agg(F.sum("n").alias("run_pages"))
    return pages.join(by_word, "book_id").join(by_run, "book_id")


def index_replaced(spark, sf_dir):
    """The terms' hits once every seventh page has another text and every eleventh is gone."""
    documents = table(spark, sf_dir, "documents")
    pages = book_pages(documents)
    changed = pages.where("doc_id % 7 = 0 OR doc_id % 11 = 0").withColumn("text", F.expr("if(doc_id % 11 = 0, NULL, concat(substring(text, 1, 200), ' quillon ', doc_id % 5))"))
    index = built(pages).replace(changed)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("quillon "), F.substring("text", 1, 40)).alias("query"))
    return search.lexical_leg(index, queries).select("query_id", "book_id", "page", F.round("lexical", 6).alias("lexical"))


def hybrid_search(spark, sf_dir):
    return search.hybrid_search(*inputs(spark, sf_dir))


def search_outcomes(spark, sf_dir):
    """Each query asks one book, some of which aren't there; some queries are blank; one book has pages that aren't indexed."""
    index, chunks, queries, vectors_asked = inputs(spark, sf_dir)
    queries = queries.withColumn("query", F.expr("if(query_id % 11 = 0, ' \n', query)"))
    asked = queries.select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 7).cast("string")).alias("book_id"))
    books = index.live().groupBy("book_id").agg(F.sum("pages").alias("n")).select("book_id", F.expr("n + if(book_id = 'src2', 5, 0)").alias("total_pages"))
    return search.outcomes(index, asked, queries, books, search.hybrid_search(index, chunks, queries, vectors_asked)).drop("mode")


def lexical_search(spark, sf_dir):
    return search.lexical_leg(_index(spark, sf_dir), _queries(spark, sf_dir)).withColumn("lexical", F.round("lexical", 6))


def _top(spark, sf_dir, chunks, asked):
    return search.ranked(vectors.nearest_pages(chunks, asked, search.LIMIT).withColumnRenamed("semantic", "score")).select("query_id", "book_id", "page", "score", "rank")


def semantic_topk(spark, sf_dir):
    chunks, asked = _vectors_alone(spark, sf_dir)
    return _top(spark, sf_dir, chunks.drop("label"), asked.drop("label"))


def semantic_of_model(spark, sf_dir):
    """A vector's model is its label's parity; every tenth vector belongs to a conversation and is no page's."""
    chunks, asked = _vectors_alone(spark, sf_dir)
    model = F.concat(F.lit("m"), (F.col("label") % 2).cast("string"))
    return _top(spark, sf_dir, chunks.where("vec_id % 10 <> 9").withColumn("model", model), asked.withColumn("model", model))


def focus_boosted(spark, sf_dir):
    index, chunks, queries, asked = inputs(spark, sf_dir)
    books = index.live().select("book_id").distinct()
    current = (F.col("query_id") % 7 + 1).cast("int")
    focus = queries.select("query_id", F.lit(1).alias("one")).join(books.withColumn("one", F.lit(1)), "one").select("query_id", "book_id", (current + 3).alias("selected_page"), current.alias("current_page"), F.lit(2).alias("chapter_from"), F.lit(12).alias("chapter_to"))
    found = search.hybrid_search(index, chunks, queries, asked, focus)
    return found.select("query_id", "book_id", "rank", "page", "score")


def term_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.search_terms(F.col("text")), "\x1f").alias("terms"))


def index_tokens(spark, sf_dir):
    tokens = T.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("digest"))


def page_factor(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.length_factor(F.col("text")), 6).alias("factor"))


def index_coverage(spark, sf_dir):
    pages, vectors = book_pages(table(spark, sf_dir, "documents")), table(spark, sf_dir, "embeddings").select("vec_id")
    met = pages.join(vectors, pages.doc_id == vectors.vec_id, "left")
    return met.groupBy("book_id").agg(F.count("*").alias("pages"), F.count("vec_id").alias("indexed"), F.max("page").cast("long").alias("last_page"))


def missing_embeddings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return state.missing(docs, table(spark, sf_dir, "embeddings"), ["vec_id"])


def stale_embeddings(spark, sf_dir):
    live = table(spark, sf_dir, "documents").where("n_chars >= 200").select(F.col("doc_id").alias("vec_id"))
    return state.still_wanted(table(spark, sf_dir, "embeddings").select("vec_id", "label"), live, ["vec_id"])


def page_range(spark, sf_dir):
    return book_pages(table(spark, sf_dir, "documents")).where(F.col("page").between(3, 12)).select("book_id", F.col("page").cast("long").alias("page"), F.length("text").cast("long").alias("chars"))


def paged_reading_whole(spark, sf_dir):
    """Every part of PART characters of each book's text.

    Places come from the pages' lengths alone; a part then gathers its own pieces of pages, so no book is one value.
    """
    pages = book_pages(table(spark, sf_dir, "documents"))
    marked = F.concat(F.when(F.col("page") > 1, "\n\n").otherwise(""), F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), T.page_text(F.col("text")))
    sized = pages.select("book_id", "page", "doc_id", F.length(marked).cast("long").alias("n"))
    # Blocks of pages, then pages of a block: a large book is many tasks' work.
    blocked = sized.withColumn("block", F.floor(F.col("page") / 1000))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("book_id", "block").agg(F.sum("n").alias("n")).select("book_id", "block", F.coalesce(F.sum("n").over(before("book_id", "block")), F.lit(0)).alias("base"))
    placed = blocked.withColumn("inner", F.coalesce(F.sum("n").over(before("book_id", "block", "page")), F.lit(0))).join(blocks, ["book_id", "block"])
    placed = placed.select("book_id", "page", (F.col("base") + F.col("inner")).alias("at"))
    texts = pages.select("book_id", "page", marked.alias("t")).join(placed, ["book_id", "page"])
    each = texts.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / PART), F.floor((F.col("at") + F.length("t") - 1) / PART))))
    skip = F.greatest(F.lit(0), F.col("part") * PART - F.col("at"))
    room = PART - F.greatest(F.lit(0), F.col("at") - F.col("part") * PART)
    pieces = each.select("book_id", "part", "page", F.substring("t", (skip + 1).cast("int"), room.cast("int")).alias("t"))
    joined = pieces.groupBy("book_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "").alias("t"))
    return joined.select("book_id", "part", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


def page_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.page_text(F.col("text")), 256).alias("content_hash"), T.token_estimate(F.col("text")).alias("tokens"))


def html_text(spark, sf_dir):
    text = T.decoded_entities(T.stripped_html(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"), F.length(T.escaped_html(text)).cast("long").alias("escaped_chars"))


def url_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr("parse_url(url, 'HOST')").alias("host"), F.expr("parse_url(url, 'QUERY', 'utm_source')").alias("utm_source"))


def quote_grounding(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.left("text", F.lit(citations.MOST_QUOTE)).alias("quote"))
    return citations.grounded(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"))


def citations_checked(spark, sf_dir):
    """An answer for each page: it quotes the page (one in seven misquotes), and names it, the next or one that isn't there.

    Pages 9,000, 18,000 and so on name page 0, which the SQL counts as a claim.
    """
    pages = book_pages(table(spark, sf_dir, "documents"))
    d = F.col("doc_id")
    named = F.when(d % 11 == 0, 9999).otherwise(F.col("page") % 9000 + F.when(d % 4 == 0, 1).otherwise(0))
    said = F.concat(F.when(d % 7 == 0, "zqx").otherwise(""), F.substring(F.regexp_replace("text", "[“”\"「」《》\n]", " "), 1, 40))
    body = F.concat(F.lit("第 "), named.cast("string"), F.lit(" 页: "), F.when(d % 2 == 0, "“").otherwise("「"), said, F.when(d % 2 == 0, "”").otherwise("」"))
    answers = pages.select(d.alias("answer_id"), "book_id", body.alias("body"))
    evidence = pages.where("doc_id % 3 = 0").select(d.alias("answer_id"), "page")
    return citations.checked(answers, evidence, pages.select("book_id", "page", "text"), least=0)


def page_chunks(spark, sf_dir):
    made = chunker.page_chunks(book_pages(table(spark, sf_dir, "documents")))
    return made.select("book_id", "page", "chunk_id", "content_hash", F.length("text").cast("long").alias("chars"))


def single_chunk_pages(spark, sf_dir):
    made = chunker.page_chunks(book_pages(table(spark, sf_dir, "documents")))
    per = made.groupBy("book_id", "page").agg(F.count("*").alias("n"), F.min("content_hash").alias("content_hash")).where("n = 1")
    return per.select("book_id", F.col("page").cast("long").alias("page"), "content_hash")


def settled_markdown(spark, sf_dir):
    """How much of each text, read as an answer still being written, is settled Markdown."""
    return table(spark, sf_dir, "documents").select("doc_id", T.settled_length(F.col("text")).cast("long").alias("settled"))


def export_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.export_name(F.col("text"), F.lit("2024-01-31").cast("date")).alias("name"), T.bounded_fact(F.col("text"), 100).alias("fact"))


NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
NAMED = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&ndash;', '-'), '&mdash;', '--'), '&hellip;', '...'), '&#39;', ''''), '&amp;', '&')"
HTML = NAMED.format(r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</?b\b[^>]*>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))")
MATCH = r"lower(regexp_replace({0}, '[\s\p{{P}}\p{{S}}]+', '', 'g'))"
COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

QUERIES = {
    "index_postings": index_postings, "index_replaced": index_replaced, "hybrid_search": hybrid_search, "search_outcomes": search_outcomes, "lexical_search_multi_term": lexical_search, "semantic_topk": semantic_topk, "semantic_topk_of_model": semantic_of_model, "focus_boosted_search": focus_boosted,
    "term_split": term_split, "index_tokens": index_tokens, "page_length_factor": page_factor, "index_coverage": index_coverage,
    "missing_embeddings_anti": missing_embeddings, "stale_embeddings_semi": stale_embeddings, "page_range_read": page_range, "paged_reading_offset": paged_reading_whole, "paged_reading_whole": paged_reading_whole,
    "content_hash": page_digest, "html_strip": html_text, "url_param_unwrap": url_param, "citation_quotes_grounding": quote_grounding,
    "citations_checked": citations_checked, "page_chunks": page_chunks, "single_chunk_pages": single_chunk_pages, "export_names": export_names, "settled_markdown": settled_markdown,
}
ORACLE_SQL = {
    "hybrid_search": f"WITH {LEXICAL}, {SEMANTIC}, {FUSED}, {_ranked()}, t_ AS (SELECT h.*, p.text, trim(q.query) AS q, instr(lower(p.text), lower(trim(q.query))) AS loc FROM hits_ h JOIN pages_ p USING (book_id, page) JOIN queries_ q USING (query_id)) SELECT query_id, book_id, rank, page, score, mode, {SNIPPET} AS snippet FROM t_",
    "lexical_search_multi_term": f"WITH {LEXICAL} SELECT query_id, book_id, page, round(lexical, 6) AS lexical FROM lexical_",
    "index_postings": f"WITH {PAGES}, w_ AS (SELECT book_id, page, unnest(w) AS t, len(w) AS dl FROM (SELECT book_id, page, {_tokens('text')} AS w FROM pages_)), s_ AS (SELECT book_id, count(*) AS pages, CAST(sum(len({_tokens('text')})) AS BIGINT) AS words FROM pages_ GROUP BY book_id), r_ AS (SELECT book_id, count(*) AS run_pages FROM (SELECT DISTINCT book_id, page, unnest(regexp_split_to_array(lower(text), '\\s+')) AS r FROM pages_) WHERE r <> '' GROUP BY book_id) SELECT s_.book_id, pages, words, count(DISTINCT (page, t)) AS word_pages, count(*) AS places, any_value(run_pages) AS run_pages FROM s_ JOIN w_ ON s_.book_id = w_.book_id JOIN r_ ON s_.book_id = r_.book_id GROUP BY s_.book_id, pages, words",
    "index_replaced": f"WITH {LEXICAL.replace(PAGES, REPLACED).replace(QUERIES_CTE, REPLACED_QUERIES)} SELECT query_id, book_id, page, round(lexical, 6) AS lexical FROM lexical_",
    "search_outcomes": f"WITH {LEXICAL.replace(QUERIES_CTE, BLANK_QUERIES)}, {SEMANTIC}, {FUSED}, {_ranked()}, a_ AS (SELECT query_id, query, 'src' || query_id % 7 AS book_id FROM queries_), b_ AS (SELECT book_id, count(*) AS n, count(*) + CASE WHEN book_id = 'src2' THEN 5 ELSE 0 END AS total FROM pages_ GROUP BY book_id), o_ AS (SELECT a_.*, n, total, query_id % 11 = 0 AS blank, (SELECT count(*) FROM hits_ h WHERE h.query_id = a_.query_id AND h.book_id = a_.book_id) AS hits FROM a_ LEFT JOIN b_ USING (book_id)) SELECT query_id, book_id, CASE WHEN blank OR n IS NULL THEN 'unavailable' WHEN n < total THEN 'partial' ELSE 'ok' END AS status, CASE WHEN blank THEN '检索词为空。' WHEN n IS NULL THEN '书库中没有这本书。' WHEN n < total THEN '索引尚未完成（' || n || '/' || total || ' 页），结果只覆盖已索引页面。' END AS note, CASE WHEN NOT blank THEN n END AS indexed_pages, CASE WHEN NOT blank THEN total END AS total_pages, CASE WHEN blank OR n IS NULL THEN 0 ELSE hits END AS n_hits FROM o_",
    "semantic_topk": f"WITH {PAGES}, {SEMANTIC}, base_ AS (SELECT *, semantic AS base, true AS hybrid FROM semantic_), {_ranked()} SELECT query_id, book_id, page, score, rank FROM hits_",
    "semantic_topk_of_model": f"WITH {PAGES}, {SEMANTIC_OF_MODEL}, base_ AS (SELECT *, semantic AS base, true AS hybrid FROM semantic_), {_ranked()} SELECT query_id, book_id, page, score, rank FROM hits_",
    "focus_boosted_search": f"WITH {LEXICAL}, {SEMANTIC}, {FUSED}, {_ranked('(CASE WHEN page = query_id % 7 + 4 THEN 0.3 ELSE 0.0 END + CASE WHEN abs(page - (query_id % 7 + 1)) <= 1 THEN 0.2 ELSE 0.0 END + CASE WHEN page BETWEEN 2 AND 12 THEN 0.1 ELSE 0.0 END)')} SELECT query_id, book_id, rank, page, score FROM hits_",
    "term_split": f"WITH u AS (SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT doc_id, {TERMS.replace('query', 'text')} AS x FROM documents)), f AS (SELECT doc_id, t, min(i) AS i FROM u GROUP BY doc_id, t), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 8) SELECT d.doc_id, coalesce(string_agg(t, chr(31) ORDER BY i), '') AS terms FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id",
    "index_tokens": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, sha256(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS w FROM documents)",
    "page_length_factor": f"SELECT doc_id, round({FACTOR.format('text')}, 6) AS factor FROM documents",
    "index_coverage": f"WITH {PAGES} SELECT book_id, count(*) AS pages, count(vec_id) AS indexed, max(page) AS last_page FROM pages_ LEFT JOIN embeddings ON vec_id = doc_id GROUP BY book_id",
    "missing_embeddings_anti": "SELECT doc_id AS vec_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "stale_embeddings_semi": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE n_chars >= 200)",
    "page_range_read": f"WITH {PAGES} SELECT book_id, page, length(text) AS chars FROM pages_ WHERE page BETWEEN 3 AND 12",
    "paged_reading_offset": f"WITH {PAGES}, w AS (SELECT book_id, string_agg('[page ' || page || ']' || chr(10) || {NORMAL.format('text')}, chr(10) || chr(10) ORDER BY page) AS f FROM pages_ GROUP BY book_id), p AS (SELECT book_id, f, unnest(range((length(f) + 19999) // 20000)) AS part FROM w) SELECT book_id, part, length(substring(f, part * 20000 + 1, 20000)) AS chars, sha256(substring(f, part * 20000 + 1, 20000)) AS digest FROM p",
    "paged_reading_whole": f"WITH {PAGES}, w AS (SELECT book_id, string_agg('[page ' || page || ']' || chr(10) || {NORMAL.format('text')}, chr(10) || chr(10) ORDER BY page) AS f FROM pages_ GROUP BY book_id), p AS (SELECT book_id, f, unnest(range((length(f) + 19999) // 20000)) AS part FROM w) SELECT book_id, part, length(substring(f, part * 20000 + 1, 20000)) AS chars, sha256(substring(f, part * 20000 + 1, 20000)) AS digest FROM p",
    "content_hash": f"SELECT doc_id, sha256({NORMAL.format('text')}) AS content_hash, CAST(ceil((length(text) + 3 * (length(text) - length(regexp_replace(text, '{CJK}', '', 'g')))) / 4.0) AS BIGINT) AS tokens FROM documents",
    "html_strip": f"SELECT page_id, t AS text, length(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_chars FROM (SELECT page_id, {HTML} AS t FROM pages)",
    "url_param_unwrap": "SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages",
    "citation_quotes_grounding": f"WITH q AS (SELECT item_id AS quote_id, left(text, 160) AS quote, {MATCH.format('left(text, 160)')} AS q FROM benchmark), p AS (SELECT doc_id, {MATCH.format('text')} AS m FROM documents), f AS (SELECT quote_id, count(*) AS n_pages, min(doc_id) AS first_page_id FROM q JOIN p ON contains(m, q) WHERE q <> '' GROUP BY quote_id) SELECT quote_id, coalesce(n_pages, 0) AS n_pages, first_page_id, CASE WHEN length(quote) > 60 THEN left(quote, 60) || '…' ELSE quote END AS excerpt FROM q LEFT JOIN f USING (quote_id)",
    "citations_checked": rf"""WITH {PAGES}, a AS (SELECT book_id, page, doc_id, CASE WHEN doc_id % 11 = 0 THEN 9999 ELSE page % 9000 + (doc_id % 4 = 0)::INT END AS named, (CASE WHEN doc_id % 7 = 0 THEN 'zqx' ELSE '' END) || substring(regexp_replace(text, '[“”"「」《》\n]', ' ', 'g'), 1, 40) AS said FROM pages_), u AS (SELECT a.* FROM a WHERE NOT (doc_id % 3 = 0 AND named = page) AND NOT EXISTS (FROM pages_ p WHERE p.book_id = a.book_id AND p.page = a.named)), n AS (SELECT doc_id, book_id, named AS page FROM a UNION SELECT doc_id, book_id, page FROM a WHERE doc_id % 3 = 0), m AS (SELECT n.doc_id, {MATCH.format('text')} AS m FROM n JOIN pages_ p ON n.book_id = p.book_id AND n.page = p.page), q AS (SELECT a.doc_id, trim(said) AS said, bool_or(contains(m, {MATCH.format('said')})) AS ok FROM a JOIN m USING (doc_id) WHERE length(trim(said)) >= 6 AND {MATCH.format('said')} <> '' AND m <> '' GROUP BY ALL) SELECT doc_id AS answer_id, 'page_claim_unindexed' AS kind, named AS page, '第 ' || named || ' 页' AS excerpt FROM u UNION ALL SELECT doc_id, 'quote_not_found', NULL, said FROM q WHERE NOT ok""",
    "single_chunk_pages": f"WITH {PAGES} SELECT book_id, page, sha256(t) AS content_hash FROM (SELECT book_id, page, {NORMAL.format('text')} AS t FROM pages_) WHERE t <> '' AND ceil((length(t) + 3 * (length(t) - length(regexp_replace(t, '{CJK}', '', 'g')))) / 4.0) <= 800",
    "export_names": rf"""SELECT doc_id, coalesce(nullif(regexp_replace(left(regexp_replace(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[<>:"/\\|?*\x00-\x1f]', '', 'g')), '[. ]+$', ''), 80), '[. ]+$', ''), ''), 'untitled') || '-conversation-20240131.md' AS name, left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), 100) AS fact FROM documents""",
}
