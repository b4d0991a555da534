"""Queries over jobs, incremental builds, the library's tables, conversations and what services send.

Orders are jobs, requests and stored vectors; customers are books of a library; events are tool calls and results;
parts carry the lines, addresses and pages of results that parsers read, a case of each kind in turn.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import text as T
from ..operators import assembly as A
from ..operators import jobs as J
from ..operators import library as L
from ..sources.shared import shared_folder, written
from ..sources.tables import book_pages, messages, table
from ..streaming import changes
from ..streaming import events as E
from .queries_search import _tokens
from .queries_state import MSG, PAGES

KINDS = ("outline", "ocr", "index", "embedding")
_KIND = "['outline', 'ocr', 'index', 'embedding'][o_orderkey % 4 + 1]"


def _kind():
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % 4 + 1).cast("int"))


def jobs_scheduled(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    version = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN null WHEN o_orderkey % 11 = 5 THEN repeat('v', 300) ELSE concat('v', o_orderkey div 7 % 3) END")
    requests = o.select(F.col("o_custkey").alias("book_id"), _kind().alias("kind"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 400 - 200).alias("priority"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 9).alias("max_attempts"), version.alias("input_version"))
    jobs = J.scheduled(J.admitted(requests))
    return jobs.select("book_id", "kind", "seq", "status", "input_version", F.col("priority").cast("long").alias("priority"), F.col("max_attempts").cast("long").alias("max_attempts"), "asked")


def _jobs(spark, sf_dir):
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'failed' END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book_id"), _kind().alias("kind"), (F.col("o_orderkey") % 50).alias("priority"), status.alias("status"), F.col("o_orderkey").alias("created"))


def jobs_paused(spark, sf_dir):
    return J.paused(_jobs(spark, sf_dir)).groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def jobs_recovered(spark, sf_dir):
    return _jobs(spark, sf_dir).withColumn("status", J.recovered(F.col("status"))).groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def opening_jobs(spark, sf_dir):
    return J.opening_jobs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"))).select("book_id", "kind", F.col("priority").cast("long").alias("priority"))


def failed_books(spark, sf_dir):
    return L.failed_books(_jobs(spark, sf_dir))


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "source")
    chunks = d.where("doc_id % 7 > 0").select(F.col("doc_id").alias("chunk_id"), "hash")
    stored = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 4 == 0, "m1").otherwise("m2").alias("model"), F.col("source").alias("book_id"))
    return chunks, stored


def embedding_plan(spark, sf_dir):
    return J.embedding_plan(*_chunks(spark, sf_dir), "m2")


def embeddings_built(spark, sf_dir):
    """Vectors of length one: a text's digest stands for what a service would give."""
    chunks, stored = _chunks(spark, sf_dir)
    embed = lambda todo: todo.select("chunk_id", F.array(F.conv(F.substring("hash", 1, 6), 16, 10).cast("double")).alias("vector"))
    built = J.embedded(chunks, stored.withColumn("vector", F.array(F.lit(-1.0))), "m2", embed)
    return built.select("chunk_id", "model", F.col("vector")[0].alias("value"))


def books_to_embed(spark, sf_dir):
    _, stored = _chunks(spark, sf_dir)
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct().withColumn("dirty", F.col("book_id").endswith("3"))
    return J.needs_embedding(books, stored.where("chunk_id % 10 > 0 AND NOT book_id LIKE '%5'"), "m2").select("book_id", "dirty")


def index_work(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents"))
    wanted = pages.select("book_id", F.col("page").cast("long").alias("page"), F.expr("substring(text, 1, cast(doc_id % 40 AS int))").alias("native"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 5, 9)).alias("recognised"))
    indexed = pages.where("page < 4 OR page > 6").select("book_id", F.col("page").cast("long").alias("page"), F.when(F.col("book_id").endswith("2") & (F.col("page") == 2), 1).otherwise(2).alias("version"))
    return J.index_work(wanted, indexed, 2).select("book_id", "page", F.sha2("text", 256).alias("text"))


def postings_replaced(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")))
    tokens = lambda t: F.split(F.lower(T.collapsed(F.regexp_replace(t, "[^A-Za-z]+", " "))), " ")
    old = pages.select("book_id", "page", F.explode(tokens(F.col("text"))).alias("token")).groupBy("book_id", "page", "token").agg(F.count("*").alias("n"))
    changed = pages.where("doc_id % 3 = 0").select("book_id", "page", F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise("new words and new pages").alias("text"))
    return J.postings_replaced(old, changed, tokens).groupBy("book_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n"))


def pages_to_recognise(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_hash"), F.lit("v2").alias("input_version"))
    cache = d.where("doc_id % 2 = 0").select("input_hash", F.when(F.col("doc_id") % 10 == 0, "v1").otherwise("v2").alias("input_version"), F.when(F.col("doc_id") % 6 == 0, "other").otherwise("e").alias("engine"), F.lit("m").alias("model"))
    return J.pages_to_recognise(d.select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"), "input_hash", "input_version"), cache, "e", "m").select("book_id", "page")


def pages_invalidated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"))
    asked = d.where("page % 5 = 0").union(d.where("book_id LIKE '%7'").select("book_id", F.lit(None).cast("long")))
    return J.invalidated(d, asked)


def _books(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_acctbal") > 0).alias("in_library"), F.col("c_nationkey").alias("updated_at"), F.concat(F.lit("/books/"), F.col("c_name")).alias("path"), F.length("c_name").alias("page_count"))


def library_shelf(spark, sf_dir):
    books = _books(spark, sf_dir)
    return L.shelf(L.removed(books, books.where("book_id % 7 = 0"))).select("book_id", "updated_at", F.col("place").cast("long").alias("place"))


def books_opened(spark, sf_dir):
    return L.opened(_books(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"))).select("book_id", "path", F.col("page_count").cast("long").alias("page_count"))


def index_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("updated_at"), (F.col("event_id") % 2).alias("extraction_version"))
    return L.signatures(rows.where("extraction_version = 1"))


def candidates_merged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 5).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("source_id"))
    return L.merged_candidates(d, ["source", "page"]).select("source", "page", F.length("text").cast("long").alias("length"), "source_id")


def _statuses(spark, sf_dir):
    m = messages(table(spark, sf_dir, "conversations"))
    focus = F.expr("CASE WHEN turn % 4 = 0 THEN concat('{\"selectedPassage\":{\"page\":', turn, ',\"text\":\"p\"}}') WHEN turn % 4 = 1 THEN '{broken' END")
    status = F.expr("CASE WHEN role = 'user' THEN 'complete' WHEN length(body) % 3 = 0 THEN 'streaming' WHEN length(body) % 3 = 1 THEN 'complete' ELSE 'error' END")
    return m.where("body IS NOT NULL AND turn IS NOT NULL").withColumn("status", status).withColumn("error", F.when(F.col("status") == "error", "e")).withColumn("focus", focus)


def _tools(m):
    """Two tool rows for each answer: the later one is written first."""
    answers = m.where("role <> 'user'").groupBy("session_id", "run_id").agg(F.min("turn").alias("turn"))
    seq = answers.withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1))))
    return seq.select("session_id", "run_id", F.timestamp_seconds(F.lit(0)).alias("at"), "seq", F.concat(F.lit("call"), F.col("seq").cast("string")).alias("call"), F.concat(F.lit("result"), F.col("turn").cast("string")).alias("result"))


def messages_as_read(spark, sf_dir):
    return A.as_read(_statuses(spark, sf_dir)).select("session_id", "turn", "status", "error", F.col("passage_page").cast("long").alias("passage_page"), "passage")


def replay_with_tools(spark, sf_dir):
    m = _statuses(spark, sf_dir)
    return A.replayed(m, _tools(m)).select("session_id", "turn", F.col("step").cast("long").alias("step"), "role", F.sha2("content", 256).alias("content"))


def model_context(spark, sf_dir):
    m = _statuses(spark, sf_dir)
    sessions = m.groupBy("session_id").agg(F.when(F.length(F.first("session_id").cast("string")) > 0, F.when(F.max("turn") % 2 == 0, F.lit(" so far ")).otherwise(" ")).alias("summary"), F.lit("and now?").alias("question"))
    c = A.context(A.replayed(m, _tools(m)), sessions)
    return c.groupBy("session_id").agg(F.count("*").alias("n"), F.max_by("content", "place").alias("last"), F.min_by(F.when(F.col("content").startswith("【"), F.col("content")), "place").alias("head"))


def session_entries(spark, sf_dir):
    m = _statuses(spark, sf_dir).select(F.concat_ws("-", "session_id", "turn").alias("id"), F.col("turn").alias("created_at"), "role", "status", "body")
    return A.session_entries(m).groupBy("role").agg(F.count("*").alias("n"), F.sum("timestamp").cast("long").alias("turns"))


def runs_finalised(spark, sf_dir):
    m = _statuses(spark, sf_dir).where("role <> 'user'").select(F.concat_ws("-", "session_id", "turn").alias("run_id"), F.when(F.col("turn") % 4 == 1, "other").otherwise("me").alias("owner"), "status", "body")
    runs = m.select("run_id", F.lit("me").alias("owner"), F.lit("complete").alias("status"), F.lit("done").alias("body"))
    written, numbered = J.finalised(m, runs, m.select("run_id", F.length("body").alias("at"), F.lit(1).alias("id")).union(m.select("run_id", F.lit(0), F.lit(2))))
    last = numbered.groupBy("run_id").agg(F.max_by("id", "seq").alias("last_tool"), F.max("seq").alias("tools"))
    return written.join(last, "run_id").select("run_id", "status", (F.col("body") == "done").alias("rewritten"), F.col("last_tool").cast("long").alias("last_tool"), F.col("tools").cast("long").alias("tools"))


def conversation_cleared(spark, sf_dir):
    m = _statuses(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("string"))
    one = m.agg(F.min("session_id")).first()[0]
    runs = m.select("session_id", F.concat_ws("-", "session_id", "run_id").alias("run_id")).distinct()
    sessions = m.select("session_id", F.lit("s").alias("summary"), F.lit(1).alias("anchor_id")).distinct()
    r, t, msgs, s = L.cleared(one, runs, runs.select("run_id", F.lit("x").alias("tool")), m, sessions)
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, x in (("runs", r), ("tools", t), ("messages", msgs), ("with_summary", s.where("summary IS NOT NULL")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def conversation_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("CASE vec_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'conversation' END").alias("source"))
    return L.without_source(v)


def attachments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("a"), (F.col("l_linenumber") % 6).cast("string")).alias("id"), F.element_at(F.array(*[F.lit(x) for x in (*A.IMAGE_TYPES, "image/bmp")]), F.expr("cast(if(l_partkey % 20 = 0, 5, l_partkey % 4 + 1) AS int)")).alias("mime"), (F.col("l_quantity") * 200_000).cast("long").alias("bytes"))
    return A.attachments_valid(rows)


def effective_settings(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", A.effective((F.col("p_size") * 1000).cast("long"), F.lit(20_000)).alias("s"), A.budget_warning(F.col("p_size").cast("int"), F.lit(50)).alias("warning"))
    return p.select("p_partkey", "s.*", "warning")


def snapshot_texts(spark, sf_dir):
    block = "array(named_struct('type', 'text', 'text', substring(text, 1, 9), 'mime', cast(null AS string), 'data', cast(null AS string)), named_struct('type', 'image', 'text', cast(null AS string), 'mime', if(doc_id % 2 = 0, 'image/png', null), 'data', text))"
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.sha2(A.truncated(F.col("text"), 2_000), 256).alias("text"), A.redacted(F.expr(block))[1].alias("note"))


def library_changes(spark, sf_dir):
    """Four changes to five tables: all pages, vectors and messages; every fifth page recognised anew; one book deleted with
    all that is its own; one conversation in seven cleared. The rows of each book that each table then has."""
    tables = changes.Tables(spark, f"{shared_folder(spark)}/pagelake/{uuid.uuid4().hex}", changes.LIBRARY)
    pages = written(book_pages(table(spark, sf_dir, "documents")))
    vectors = table(spark, sf_dir, "embeddings").join(pages, F.col("vec_id") == F.col("doc_id")).select("book_id", "page", F.lit("c0").alias("chunk"), F.col("embedding").cast("array<double>").alias("embedding"))
    said = table(spark, sf_dir, "conversations").select(F.concat(F.lit("src"), (F.col("conv_id") % 3).cast("string")).alias("book_id"), F.col("conv_id").cast("string").alias("session_id"), "turn", F.col("text").alias("body"))
    plain = pages.select("book_id", F.col("page").cast("long").alias("page"), "text")
    tables.apply({"books": pages.select("book_id", F.lit(False).alias("dirty")).distinct(), "pages": plain, "postings": changes.postings_of(plain), "vectors": vectors, "messages": said})
    changes.recognised(tables, pages.where("doc_id % 5 = 0").select("book_id", "page", F.concat(F.substring("text", 1, 60), F.lit(" recognised")).alias("text")))
    changes.books_deleted(tables, pages.where("book_id = 'src1'").select("book_id"))
    changes.conversations_cleared(tables, said.where("cast(session_id AS long) % 7 = 0"))
    counts = [tables.current(name).groupBy("book_id").agg(F.count("*").alias("n"), detail.alias("detail")).select(F.lit(name).alias("name"), "book_id", "n", "detail") for name, detail in (("books", F.count_if(F.col("dirty"))), ("pages", F.sum(F.length("text"))), ("postings", F.sum(F.size("positions"))), ("vectors", F.sum("page")), ("messages", F.sum("turn")))]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3]).union(counts[4])


def events_of_started_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type")
    return A.of_run(e, e.where("event_type = 'signup'")).groupBy("run_id").agg(F.count("*").alias("n"))


ERROR_TEXTS = ("HTTP 401", "Rate limit reached", "request timed out", "ECONNREFUSED 10.0.0.1", "images are not supported", "1401 tokens bad", "maximum context length is 8192 tokens", "204 tokens > 180 tokens maximum: too many tokens", "prompt is too long")


def model_errors(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ERROR_TEXTS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    message = F.concat(text, F.lit(" "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", P.model_error(F.when(F.col("p_size") > 5, "error").otherwise("stop"), F.when(F.col("p_size") > 45, "429"), message).alias("kind"), P.reported_window(message).alias("window"))


def chat_endpoints(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, ("", "/", "/v1", "/v1/chat/completions?x=1", "/v1/messages", "/api/v2#f", "/v1/embeddings"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    url = F.concat(F.lit("https://h"), F.col("p_size").cast("string"), F.lit(".example"), tail)
    return table(spark, sf_dir, "part").select("p_partkey", P.chat_endpoint(F.when(F.col("p_size") % 2 == 0, "openai").otherwise("other"), url).alias("chat"), P.embeddings_endpoint(url).alias("embeddings"))


def stream_lines(spark, sf_dir):
    line = F.expr("""CASE p_partkey % 4 WHEN 0 THEN concat('data: {"id":"', p_partkey, '", "object":"chunk","created":17.50,"model":"m","choices":[{"index":0,"delta":{"role":null,"content":"c","reasoning_content":"r","tool_calls":[{"index":0,"id":"t","function":{"name":"', p_size, '","arguments":"{\\\\"a\\\\": 1}"}}],"reasoning":{"deep":[1,2]}},"finish_reason":null}],"usage":{"total":', p_size, '}}')
      WHEN 1 THEN concat('data: {"id":"', p_partkey, '","choices":[{"index":0,"delta":{"content":"c"}}]}') WHEN 2 THEN 'data: [DONE]' ELSE concat('event: ', p_name) END""")
    return table(spark, sf_dir, "part").select("p_partkey", P.stream_line(line).alias("line"))


def search_results(spark, sf_dir):
    """Two results a page; the first has a snippet, the second's address is wrapped."""
    page = F.expr("""if(p_partkey % 10 = 9, '<form id="challenge-form">', concat('<p><a class="x result__a" href="https://a.example/', p_partkey, '?q=1&amp;r=2">The <b class="k">', p_brand, '</b> Q&amp;A</a><a class="result__snippet">1 &lt; 2 <i>so</i></a></p>',
      '<a rel="n" class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fb.example%2F', p_partkey, '&amp;rut=1">Second</a>'))""")
    rows = table(spark, sf_dir, "part").select("p_partkey", page.alias("html"))
    return rows.select("p_partkey", P.is_challenge(F.col("html")).alias("challenge"), F.posexplode_outer(P.result_links(F.col("html"))).alias("at", "r")).select("p_partkey", "challenge", F.col("at").cast("long").alias("at"), "r.title", "r.url", "r.snippet")


def payload_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.array(F.substring("text", 1, 7)).alias("images"))
    key = P.payload_key(F.col("text"), F.col("images"))
    first = d.select("doc_id", key.alias("k"), F.sha2(P.args_preview(F.col("text")), 256).alias("preview"), P.payload_chars(F.col("text"), F.col("images")).cast("long").alias("chars"), P.entry_key(F.col("doc_id") % 3 + 1, F.substring("text", 1, 12)).alias("entry"), P.image_name(F.sha2("text", 256), F.when(F.col("doc_id") % 2 == 0, "image/jpeg").otherwise("image/png")).alias("image"))
    return first.join(first.groupBy(F.col("k").alias("_k")).agg(F.min("doc_id").alias("first_id")), F.col("k") == F.col("_k")).select("doc_id", "first_id", "preview", "chars", "entry", "image")


def loop_verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 > 0, "search").otherwise("pages").alias("tool"), (F.col("event_id") % 2).cast("string").alias("args_hash"), (F.col("event_id") % 3).cast("string").alias("result_hash"), F.expr("cast(if(event_type = 'click', 100, 600) AS int)").alias("chars"))
    return E.repeat_verdicts(e)


def offset_distribution(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 4).alias("page_offset")).agg(F.count("*").alias("votes"))
    spread = e.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_offset", "votes")))).alias("m"))
    return spread.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ",").alias("spread"))


_D = "d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS hash FROM documents)"
_STORED = _D + ", s AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE hash END AS hash, CASE WHEN doc_id % 4 = 0 THEN 'm1' ELSE 'm2' END AS model FROM d WHERE doc_id % 3 > 0)"
_PLAN = _STORED + """, c AS (SELECT * FROM d WHERE doc_id % 7 > 0), plan AS (SELECT coalesce(c.doc_id, s.doc_id) AS chunk_id, c.hash, CASE WHEN c.doc_id IS NULL THEN 'stale' WHEN s.doc_id IS NULL THEN 'new' WHEN c.hash <> s.hash THEN 'changed' WHEN s.model <> 'm2' THEN 'model' ELSE 'keep' END AS action FROM c FULL JOIN s ON c.doc_id = s.doc_id)"""
_JOBS = f"j AS (SELECT o_orderkey AS id, o_custkey AS book_id, {_KIND} AS kind, o_orderkey % 50 AS priority, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status FROM orders)"
_ST = MSG + ", st AS (SELECT *, CASE WHEN role = 'user' THEN 'complete' WHEN length(body) % 3 = 0 THEN 'streaming' WHEN length(body) % 3 = 1 THEN 'complete' ELSE 'error' END AS status FROM m WHERE body IS NOT NULL AND turn IS NOT NULL)"
_REPLAY = _ST + """, u AS (SELECT * FROM st WHERE role = 'user' OR status = 'complete'), a AS (SELECT session_id, run_id, min(turn) AS turn FROM u WHERE role <> 'user' GROUP BY ALL), f AS (SELECT session_id, run_id, min(turn) AS first FROM st WHERE role <> 'user' GROUP BY ALL),
t AS (SELECT session_id, turn, x.step, x.role, x.content FROM (SELECT session_id, turn, unnest([{'step': 0, 'role': 'assistant', 'content': 'call1'}, {'step': 1, 'role': 'tool', 'content': 'result' || first}, {'step': 2, 'role': 'assistant', 'content': 'call2'}, {'step': 3, 'role': 'tool', 'content': 'result' || first}]) AS x FROM a JOIN f USING (session_id, run_id))),
r AS (SELECT session_id, turn, step, role, content FROM t UNION ALL SELECT session_id, turn, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.session_id = u.session_id AND a.turn = u.turn) THEN 4 ELSE 0 END, role, body FROM u)"""

QUERIES = {
    "jobs_scheduled": jobs_scheduled, "jobs_paused": jobs_paused, "jobs_recovered": jobs_recovered, "opening_jobs": opening_jobs, "failed_books": failed_books, "embedding_plan": embedding_plan, "embeddings_built": embeddings_built, "books_to_embed": books_to_embed,
    "index_work": index_work, "postings_replaced": postings_replaced, "pages_to_recognise": pages_to_recognise, "pages_invalidated": pages_invalidated, "library_shelf": library_shelf, "library_changes": library_changes, "books_opened": books_opened, "index_signatures": index_signatures,
    "candidates_merged": candidates_merged, "messages_as_read": messages_as_read, "replay_with_tools": replay_with_tools, "model_context": model_context, "session_entries": session_entries, "runs_finalised": runs_finalised, "conversation_cleared": conversation_cleared,
    "conversation_vectors_dropped": conversation_vectors, "attachments_valid": attachments, "effective_settings": effective_settings, "snapshot_texts": snapshot_texts, "events_of_started_runs": events_of_started_runs, "model_errors": model_errors,
    "chat_endpoints": chat_endpoints, "stream_lines": stream_lines, "search_results": search_results, "payload_keys": payload_keys, "loop_verdicts": loop_verdicts, "offset_distribution": offset_distribution,
}
ORACLE_SQL = {
    "jobs_scheduled": f"""WITH q AS (SELECT o_custkey AS b, {_KIND} AS kind, o_orderkey AS seq, greatest(-100, least(100, o_orderkey % 400 - 200)) AS priority, CASE WHEN o_orderkey % 5 > 0 THEN greatest(1, least(5, o_orderkey % 9)) ELSE 3 END AS tries,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 11 = 5 THEN NULL ELSE 'v' || (o_orderkey // 7 % 3) END AS v FROM orders),
p AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY b, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, row_number() OVER (PARTITION BY b, kind ORDER BY seq) AS r FROM q),
n AS (SELECT *, sum(CASE WHEN r = 1 OR v IS NOT NULL AND v IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY b, kind ORDER BY seq) AS job FROM p),
g AS (SELECT b, kind, job, min(seq) AS seq, count(*) AS asked FROM n GROUP BY ALL)
SELECT g.b AS book_id, g.kind, g.seq, CASE WHEN g.job = max(g.job) OVER (PARTITION BY g.b, g.kind) THEN 'queued' ELSE 'cancelled' END AS status, n.v AS input_version, n.priority, n.tries AS max_attempts, g.asked FROM g JOIN n ON n.b = g.b AND n.kind = g.kind AND n.seq = g.seq""",
    "jobs_paused": f"WITH {_JOBS}, t AS (SELECT priority AS p, id AS c FROM j WHERE kind = 'ocr' AND priority > 0 AND status = 'queued' ORDER BY priority DESC, id DESC LIMIT 1) SELECT kind, CASE WHEN status = 'running' AND priority < (SELECT p FROM t) AND id <= (SELECT c FROM t) THEN 'paused' ELSE status END AS status, count(*) AS n, sum(id)::BIGINT AS ids FROM j GROUP BY ALL",
    "jobs_recovered": f"WITH {_JOBS} SELECT CASE status WHEN 'running' THEN 'queued' ELSE status END AS status, count(*) AS n, sum(id)::BIGINT AS ids FROM j GROUP BY 1",
    "opening_jobs": "SELECT c_custkey AS book_id, k AS kind, CAST(p AS BIGINT) AS priority FROM customer, (VALUES ('outline', 25), ('ocr', 20), ('index', 10), ('embedding', 0)) v(k, p)",
    "failed_books": "SELECT DISTINCT o_custkey AS book_id FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    "embedding_plan": f"WITH {_PLAN} SELECT chunk_id, action FROM plan",
    "embeddings_built": f"WITH {_PLAN} SELECT chunk_id, 'm2' AS model, CASE WHEN action = 'keep' THEN -1.0 ELSE CAST(CAST('0x' || substring(hash, 1, 6) AS BIGINT) AS DOUBLE) END::DOUBLE AS value FROM plan WHERE action <> 'stale'",
    "books_to_embed": f"WITH {_STORED} SELECT DISTINCT source AS book_id, source LIKE '%3' AS dirty FROM documents WHERE source LIKE '%3' OR NOT EXISTS (SELECT 1 FROM s WHERE s.source = documents.source AND model = 'm2' AND doc_id % 10 > 0 AND NOT source LIKE '%5')",
    "index_work": f"""WITH {PAGES}, w AS (SELECT book_id, page, doc_id, substring(text, 1, doc_id % 40) AS n, CASE WHEN doc_id % 2 = 0 THEN substring(text, 5, 9) END AS r FROM pages_), g AS (SELECT book_id, page FROM pages_ WHERE (page < 4 OR page > 6) AND NOT (book_id LIKE '%2' AND page = 2)),
x AS (SELECT book_id, max(page) AS done FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page) AS k FROM g) WHERE k = page GROUP BY 1)
SELECT book_id, page, sha256(CASE WHEN length(trim(n)) >= 16 THEN n WHEN length(trim(r)) > 0 THEN r ELSE coalesce(n, '') END) AS text FROM w LEFT JOIN x USING (book_id) WHERE page > coalesce(done, 0)""",
    "postings_replaced": rf"""WITH {PAGES}, n AS (SELECT book_id, page, CASE WHEN doc_id % 3 > 0 THEN coalesce(text, '') WHEN doc_id % 2 = 1 THEN 'new words and new pages' END AS t FROM pages_ WHERE doc_id % 3 > 0 OR doc_id % 2 = 1),
k AS (SELECT book_id, page, unnest(string_split(lower(trim(regexp_replace(regexp_replace(t, '[^A-Za-z]+', ' ', 'g'), '\s+', ' ', 'g'))), ' ')) AS token FROM n) SELECT book_id, page, count(DISTINCT token) AS n_tokens, count(*) AS n FROM k GROUP BY ALL""",
    "pages_to_recognise": f"WITH {_D} SELECT source AS book_id, doc_id AS page FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE doc_id % 2 = 0 AND doc_id % 10 > 0 AND doc_id % 6 > 0)",
    "pages_invalidated": "SELECT source AS book_id, doc_id AS page FROM documents WHERE doc_id % 5 > 0 AND NOT source LIKE '%7'",
    "library_changes": f"WITH {PAGES}, p AS (SELECT book_id, page, doc_id, CASE WHEN doc_id % 5 = 0 THEN substring(text, 1, 60) || ' recognised' ELSE text END AS t FROM pages_ WHERE book_id <> 'src1'), w AS (SELECT book_id, page, unnest({_tokens('t')}) AS token FROM p) SELECT 'books' AS name, book_id, CAST(1 AS BIGINT) AS n, CAST(bool_or(doc_id % 5 = 0) AS BIGINT) AS detail FROM p GROUP BY book_id UNION ALL SELECT 'pages', book_id, count(*), CAST(sum(length(t)) AS BIGINT) FROM p GROUP BY book_id UNION ALL SELECT 'postings', book_id, count(DISTINCT (page, token)), count(*) FROM w GROUP BY book_id UNION ALL SELECT 'vectors', book_id, count(*), CAST(sum(page) AS BIGINT) FROM p JOIN embeddings ON vec_id = doc_id WHERE doc_id % 5 <> 0 GROUP BY book_id UNION ALL SELECT 'messages', 'src' || conv_id % 3, count(*), CAST(sum(turn) AS BIGINT) FROM conversations WHERE conv_id % 3 <> 1 AND conv_id % 7 <> 0 GROUP BY conv_id % 3",
    "library_shelf": "SELECT c_custkey AS book_id, c_nationkey AS updated_at, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS place FROM customer WHERE c_acctbal > 0 AND c_custkey % 7 > 0",
    "books_opened": "SELECT c_custkey AS book_id, '/books/' || c_name AS path, length(c_name) AS page_count FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    "index_signatures": "SELECT user_id AS book_id, count(*) AS n, coalesce(max(CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END), '') AS latest FROM events WHERE event_id % 2 = 1 GROUP BY 1",
    "candidates_merged": "SELECT source, doc_id % 5 AS page, max(length(coalesce(text, ''))) AS length, min(doc_id) AS source_id FROM documents GROUP BY ALL",
    "messages_as_read": f"WITH {_ST} SELECT session_id, turn, CASE WHEN status = 'streaming' THEN 'cancelled' ELSE status END AS status, CASE status WHEN 'streaming' THEN '程序中断，回答未完成。' WHEN 'error' THEN 'e' END AS error, CASE WHEN turn % 4 = 0 THEN CAST(turn AS BIGINT) END AS passage_page, CASE WHEN turn % 4 = 0 THEN 'p' END AS passage FROM st",
    "replay_with_tools": f"WITH {_REPLAY} SELECT session_id, turn, CAST(step AS BIGINT) AS step, role, sha256(content) AS content FROM r",
    "model_context": f"WITH {_REPLAY}, w AS (SELECT session_id, max(turn) % 2 = 0 AS has FROM st GROUP BY 1) SELECT session_id, (SELECT count(*) FROM r WHERE r.session_id = w.session_id) + 1 + CASE WHEN has THEN 1 ELSE 0 END AS n, 'and now?' AS last, CASE WHEN has THEN '【Conversation Summary】' || chr(10) || 'so far' END AS head FROM w",
    "session_entries": f"WITH {_ST} SELECT role, count(*) AS n, sum(turn)::BIGINT AS turns FROM st WHERE role = 'user' OR status = 'complete' GROUP BY 1",
    "runs_finalised": f"WITH {_ST} SELECT session_id || '-' || turn AS run_id, CASE WHEN status = 'streaming' AND turn % 4 <> 1 THEN 'complete' ELSE status END AS status, status = 'streaming' AND turn % 4 <> 1 AS rewritten, CASE WHEN length(body) > 0 THEN 1 ELSE 2 END AS last_tool, 2 AS tools FROM st WHERE role <> 'user'",
    "conversation_cleared": f"WITH {_ST}, o AS (SELECT *, session_id || '-' || run_id AS r FROM st WHERE CAST(session_id AS VARCHAR) <> (SELECT min(CAST(session_id AS VARCHAR)) FROM st)) SELECT 'runs' AS part, count(DISTINCT r) AS n FROM o UNION ALL SELECT 'tools', count(DISTINCT r) FROM o UNION ALL SELECT 'messages', count(*) FROM o UNION ALL SELECT 'with_summary', count(DISTINCT session_id) FROM o",
    "conversation_vectors_dropped": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'pdf' END AS source FROM embeddings WHERE vec_id % 3 <> 1",
    "attachments_valid": "SELECT l_orderkey AS request_id, bool_and(l_partkey % 20 > 0 AND l_quantity * 200000 BETWEEN 1 AND 8388608) AND count(*) <= 4 AND count(DISTINCT l_linenumber % 6) = count(*) AND sum(CAST(l_quantity * 200000 AS BIGINT)) <= 25165824 AS valid, sum(CAST(l_quantity * 200000 AS BIGINT))::BIGINT AS bytes FROM lineitem GROUP BY 1",
    "effective_settings": "SELECT p_partkey, CAST(p_size * 300 AS BIGINT) AS reserve, CAST(greatest(1, least(20000, p_size * 700 - 1000)) AS BIGINT) AS keep, CAST(greatest(2000, p_size * 250) AS BIGINT) AS oversized, '系统提示：你已使用 ' || p_size || '/50 轮。请把重要发现整理好带进最终回答，并继续任务——不要因为这个提示就停下来。' AS warning FROM part",
    "snapshot_texts": "SELECT doc_id, sha256(CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '…（已截断）' ELSE text END) AS text, '[图片已省略：' || CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'unknown' END || '，约 ' || CAST(floor(length(text) * 3 / 4.0 / 1024 + 0.5) AS INT) || ' KB]' AS note FROM documents WHERE text IS NOT NULL",
    "events_of_started_runs": "SELECT user_id AS run_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY 1",
    "model_errors": "SELECT p_partkey, CASE WHEN p_size > 5 THEN CASE WHEN p_partkey % 9 = 0 THEN 'AUTHENTICATION_ERROR' WHEN p_size > 45 OR p_partkey % 9 = 1 THEN 'RATE_LIMITED' WHEN p_partkey % 9 = 2 THEN 'TIMEOUT' WHEN p_partkey % 9 = 3 THEN 'NETWORK_ERROR' ELSE 'INVALID_RESPONSE' END END AS kind, CAST(CASE p_partkey % 9 WHEN 6 THEN 8192 WHEN 7 THEN 180 WHEN 8 THEN 0 END AS BIGINT) AS window FROM part",
    "chat_endpoints": """SELECT p_partkey, h || CASE WHEN p_size % 2 = 0 THEN ['/v1', '/v1', '/v1', '/v1', '/v1/messages/v1', '/api/v2', '/v1/embeddings/v1'][k] || '/chat/completions' ELSE ['', '', '', '/v1/chat/completions', '', '/api/v2', '/v1/embeddings'][k] || '/v1/messages' END AS chat,
  h || ['/v1', '/v1', '/v1', '/v1/chat/completions/v1', '/v1/messages/v1', '/api/v2/v1', '/v1'][k] || '/embeddings' AS embeddings FROM (SELECT p_partkey, p_size, 'https://h' || p_size || '.example' AS h, p_partkey % 7 + 1 AS k FROM part)""",
    "stream_lines": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'data: {"id":"' || p_partkey || '","object":"chunk","created":17.50,"model":"m","choices":[{"index":0,"delta":{"role":null,"content":"c","tool_calls":[{"index":0,"id":"t","function":{"name":"' || p_size || '","arguments":"{\\"a\\": 1}"}}]},"finish_reason":null}],"usage":{"total":' || p_size || '}}' WHEN 1 THEN 'data: {"id":"' || p_partkey || '","choices":[{"index":0,"delta":{"content":"c"}}]}' WHEN 2 THEN 'data: [DONE]' ELSE 'event: ' || p_name END AS line FROM part""",
    "search_results": """SELECT p_partkey, false AS challenge, CAST(0 AS BIGINT) AS at, 'The ' || p_brand || ' Q&A' AS title, 'https://a.example/' || p_partkey || '?q=1&r=2' AS url, '1 < 2 so' AS snippet FROM part WHERE p_partkey % 10 <> 9
UNION ALL SELECT p_partkey, false, 1, 'Second', 'https://b.example/' || p_partkey, '' FROM part WHERE p_partkey % 10 <> 9 UNION ALL SELECT p_partkey, true, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 9""",
    "payload_keys": r"""SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, sha256(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120)) AS preview, length(text) + floor(length(substring(text, 1, 7)) * 3 / 4.0)::BIGINT AS chars, (doc_id % 3 + 1) || '|' || lower(substring(text, 1, 12)) AS entry, sha256(text) || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS image FROM documents WHERE text IS NOT NULL""",
    "loop_verdicts": """WITH e AS (SELECT user_id AS run_id, event_id AS seq, event_id % 5 > 0 AS tool, event_id % 2 AS a, event_id % 3 AS r, event_type <> 'click' AS long FROM events),
n AS (SELECT *, list({'tool': tool, 'a': a, 'r': r}) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS w FROM e), c AS (SELECT *, list_filter(coalesce(w, []), lambda s: s.tool = tool AND s.r = r) AS chain FROM n), v AS (SELECT *, len(chain) + 1 AS p, len(list_filter(chain, lambda s: s.a = a)) > 0 AS alike FROM c)
SELECT run_id, seq, CASE WHEN p = 1 THEN 'full' WHEN alike THEN CASE WHEN p >= 4 THEN 'final' WHEN p = 3 THEN 'warn' WHEN long THEN 'stub' ELSE 'full' END WHEN NOT long THEN 'full' WHEN p >= 3 THEN 'final' ELSE 'stub' END AS verdict FROM v""",
    "offset_distribution": "SELECT user_id, string_agg(o || ':' || n, ',' ORDER BY o) AS spread FROM (SELECT user_id, event_id % 4 AS o, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1",
}
