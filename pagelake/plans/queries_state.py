"""Queries over messages, jobs, outlines, geometry and events, seen in the given tables.

Jobs: an order is a job of book o_custkey. Outlines: a document's first line is a heading, its length stands for a
printed page number. Rectangles: part and supplier attributes. Streams run here as batches; tests run them as streams.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import conversation as C
from ..operators import headings as H
from ..operators import outline as O
from ..operators import state
from ..sources.tables import TRACE_KINDS, book_pages, messages, table, traces
from ..streaming import events as E

PAGES = "pages_ AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, doc_id, text FROM documents)"
MSG = "m AS (SELECT conv_id AS session_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id, role, text AS body FROM conversations)"
EST = r"CAST(ceil((length({0}) + 3 * (length({0}) - length(regexp_replace({0}, '[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]', '', 'g')))) / 4.0) AS BIGINT)".replace("{3000}", "{{3000}}").replace("{9fff}", "{{9fff}}").replace("{ff00}", "{{ff00}}").replace("{ffef}", "{{ffef}}")
RET = f"tok AS (SELECT session_id, run_id, sum({EST.format('body')}) AS tokens FROM m GROUP BY ALL), ret AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY run_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200 AS retained FROM tok)"


def _messages(spark, sf_dir):
    return messages(table(spark, sf_dir, "conversations"))


def retained_runs(spark, sf_dir):
    return C.retained_runs(_messages(spark, sf_dir), 200)


def elision(spark, sf_dir):
    """Answers as tools' results, every fifth with two images."""
    m = _messages(spark, sf_dir)
    tools = m.where("role <> 'user'").select("session_id", "run_id", "turn", F.concat(F.lit("tool "), F.col("turn").cast("string")).alias("title"), "body", F.expr("if(turn % 5 = 0, array(turn + 1, turn + 2), cast(array() AS array<int>))").alias("media_pages"))
    done = C.elided(tools, C.retained_runs(m, 200), 150)
    return done.select("session_id", "turn", "elided", F.col("saved").cast("long").alias("saved"), F.sha2("body", 256).alias("body"))


def replay(spark, sf_dir):
    return C.replay(_messages(spark, sf_dir)).select("session_id", "turn", "run_id", "role", F.col("position").cast("long").alias("position"))


def export(spark, sf_dir):
    """Every seventh answer isn't complete, some turns quote a page or have evidence, every fifth conversation has no title."""
    m = _messages(spark, sf_dir).withColumns({
        "status": F.when(F.col("turn") % 7 == 3, "interrupted").otherwise("complete"), "passage_page": F.expr("if(turn % 4 = 0, turn + 1, null)"),
        "evidence_pages": F.expr("if(turn % 3 = 1, array(turn + 15, turn + 2, turn + 15), cast(null AS array<int>))"), "created_at": F.expr("if(session_id % 4 = 3, null, timestamp'2024-01-30 20:00:00' + make_dt_interval(0, turn * 2))"),
    })
    titles = m.select("session_id").distinct().withColumn("title", F.expr("if(session_id % 5 = 0, '\\n', concat('Book\\r\\nof ', session_id, '\\t'))"))
    return C.exported(m, titles, F.lit("2024-02-03").cast("date")).select("session_id", "n_messages", F.sha2("markdown", 256).alias("digest"))


def evidence(spark, sf_dir):
    """Answers: labels' groups; a vector's first component is its score, its id's page its page."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("answer_id"), (F.col("vec_id") % 40 + 1).alias("page"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return C.top_evidence(e).select("answer_id", "page", "score", F.col("place").cast("long").alias("place"))


def inherited_evidence(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("evidence", F.when(F.length("body") % 3 == 0, F.length("body")))
    return C.inherited(m, "evidence").select("session_id", "turn", F.col("evidence").cast("long").alias("evidence"))


def interrupted(spark, sf_dir):
    """What was still being written at the last turn of a session is cancelled."""
    m = _messages(spark, sf_dir)
    last = m.groupBy("session_id").agg(F.max("turn").alias("turn"))
    status = F.when(F.col("role") == "user", "cancelled").otherwise("complete")
    return m.join(last, ["session_id", "turn"]).select("session_id", "turn", status.alias("status"))


def tool_quota(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    q = state.quota(e, ["user_id", "event_type"], ["ts", "event_id"], 5)
    return q.groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS book_id, o_orderpriority AS kind, CAST(round(o_totalprice) AS BIGINT) % 201 - 100 AS priority, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS created_at FROM orders)"


def _jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("kind"), (F.round("o_totalprice").cast("long") % 201 - 100).alias("priority"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


ANY_JOBS = "any_ AS (SELECT o_orderkey AS job_id, o_custkey AS book_id, o_orderpriority AS kind, ['running', 'queued', 'paused', 'failed', 'completed', 'cancelled'][CAST(floor(o_totalprice) AS BIGINT) % 6 + 1] AS status, o_orderdate AS updated_at FROM orders)"


def _any_jobs(spark, sf_dir):
    """Orders as jobs in any of the six states."""
    status = F.element_at(F.array(*map(F.lit, (*state.URGENCY, "completed", "cancelled"))), (F.floor("o_totalprice") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("kind"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))


def job_queue(spark, sf_dir):
    return state.queue_order(_jobs(spark, sf_dir)).select("job_id", "book_id", F.col("position").cast("long").alias("position"))


def latest_jobs(spark, sf_dir):
    return state.latest_per_kind(_any_jobs(spark, sf_dir)).select("book_id", "kind", "job_id", "status", "urgency")


def transitions(spark, sf_dir):
    action = F.element_at(F.array(F.lit("pause"), F.lit("resume"), F.lit("cancel")), (F.col("job_id") % 3 + 1).cast("int"))
    return _jobs(spark, sf_dir).select("job_id", action.alias("action"), state.transition_valid(action, F.col("status")).alias("valid"))


def job_changes(spark, sf_dir):
    action = F.element_at(F.array(F.lit("pause"), F.lit("resume"), F.lit("cancel")), (F.col("job_id") % 3 + 1).cast("int"))
    jobs = _any_jobs(spark, sf_dir).select("job_id", action.alias("action"), "status", (F.col("job_id") % 4).alias("attempts"), F.col("book_id").alias("claim_id"))
    return state.transitioned(jobs).select("job_id", "ok", "status", F.col("attempts").cast("long").alias("attempts"), "claim_id")


def reading_state(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", state.clamped(F.floor("c_acctbal"), 1, 300).cast("long").alias("page"), F.round(state.clamped(F.col("c_acctbal") / 10, 25.0, 500.0), 6).alias("zoom"), F.round(F.greatest(F.lit(0.0), F.col("c_acctbal")), 6).alias("scroll_top"))


def upsert(spark, sf_dir):
    """Events as changes to one row a user and type: the last one stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    old, new = e.where("event_id < 400"), e.where("event_id >= 400")
    first = state.latest_wins(old, ["user_id", "event_type"], [F.col("event_id")])
    changes = state.latest_wins(new, ["user_id", "event_type"], [F.col("event_id")])
    return state.upserted(first, changes, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def cascade(spark, sf_dir):
    """What is left of pages when books are deleted."""
    pages = book_pages(table(spark, sf_dir, "documents")).select("book_id", "doc_id")
    doomed = pages.groupBy("book_id").agg(F.sum("doc_id").alias("s")).where("s % 3 = 0")
    return state.without_book(pages, doomed)


def covered(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents")).withColumn("covered", F.length("text") >= 120)
    return state.covered_prefix(pages)


#: A page's heading: a chapter, a section of the chapter before, a dotted section, a title that many pages share, one that none shares.
LABELS = r"heads AS (SELECT book_id, page, doc_id, page AS ord, CASE doc_id % 5 WHEN 0 THEN 'Chapter ' || (1 + page % 12) || ' ' WHEN 1 THEN 'section ' || (1 + doc_id % 4) || ' ' WHEN 2 THEN (1 + doc_id % 9) || '.' || (1 + doc_id % 8) || ' ' WHEN 3 THEN 'Contents ' || chr(CAST(97 + doc_id % 3 AS INT)) ELSE 'Note ' || doc_id || ' ' END || CASE WHEN doc_id % 5 = 3 THEN '' ELSE string_split(text, chr(10))[1] END AS label FROM pages_)"


def _headings(spark, sf_dir):
    first = F.split("text", "\n")[0]
    d, number = F.col("doc_id"), lambda x: x.cast("string")
    label = (F.when(d % 5 == 0, F.concat(F.lit("Chapter "), number(1 + F.col("page") % 12), F.lit(" "), first))
             .when(d % 5 == 1, F.concat(F.lit("section "), number(1 + d % 4), F.lit(" "), first))
             .when(d % 5 == 2, F.concat(number(1 + d % 9), F.lit("."), number(1 + d % 8), F.lit(" "), first))
             .when(d % 5 == 3, F.concat(F.lit("Contents "), F.char(97 + d % 3)))
             .otherwise(F.concat(F.lit("Note "), number(d), F.lit(" "), first)))
    return book_pages(table(spark, sf_dir, "documents")).select("book_id", "page", "doc_id", label.alias("label"), F.col("page").cast("long").alias("ord"))


def running_headers(spark, sf_dir):
    return H.first_of_each(_headings(spark, sf_dir)).select("book_id", F.col("page").cast("long").alias("page"), F.col("key").alias("ordinal"))


def offset_vote(spark, sf_dir):
    """Votes: chapters' numbers against pages; short texts vote as contents pages."""
    h = book_pages(table(spark, sf_dir, "documents"))
    kind = F.when(F.length("text") < 400, "toc").when(F.col("doc_id") % 5 == 0, "anchor").otherwise("body")
    votes = h.select("book_id", kind.alias("kind"), (F.col("page") - F.floor(F.col("page") * 0.9)).cast("long").alias("offset"))
    return O.page_offset(votes)


NODES = "nodes AS (SELECT book_id, page AS ord, 1 + doc_id % 3 AS depth, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE page * 3 END AS page, 'n' || page AS label FROM pages_), totals AS (SELECT book_id, max(page) * 3 + 5 AS total FROM pages_ GROUP BY book_id)"


def _nodes(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents"))
    nodes = pages.select("book_id", F.col("page").cast("long").alias("ord"), (1 + F.col("doc_id") % 3).alias("depth"), F.when(F.col("doc_id") % 4 != 0, F.col("page") * 3).cast("long").alias("page"), F.concat(F.lit("n"), F.col("page").cast("string")).alias("label"))
    return nodes, pages.groupBy("book_id").agg((F.max("page") * 3 + 5).cast("long").alias("total"))


def chapter_asof(spark, sf_dir):
    nodes, totals = _nodes(spark, sf_dir)
    pages = nodes.select("book_id", (F.col("ord") * 3 + 1).alias("page"))
    return O.chapter_of(pages, O.chapter_ranges(nodes, totals)).select("book_id", "page", F.col("start").cast("long").alias("start"))


def chapter_ranges(spark, sf_dir):
    return O.chapter_ranges(*_nodes(spark, sf_dir))


def section_range(spark, sf_dir):
    return O.section_ranges(*_nodes(spark, sf_dir))


def monotone(spark, sf_dir):
    nodes, _ = _nodes(spark, sf_dir)
    return O.monotone(nodes.withColumn("page", (F.col("page") * 7 % 50).cast("long"))).select("book_id", "ord", "page")


#: A book for each source and branch of the gate: as it is, labels alike, numbers, placeholders, a bookmark a page, few resolved, blank labels.
GATED = NODES + """, gated AS (SELECT book_id || '-' || v AS book_id, ord, CASE v WHEN 4 THEN ord WHEN 5 THEN CASE WHEN ord % 3 = 0 THEN page END ELSE page END AS page, CASE v WHEN 1 THEN 'same' WHEN 2 THEN CAST(ord AS VARCHAR) WHEN 3 THEN '未命名目录 ' || ord WHEN 6 THEN '  ' ELSE label END AS label FROM (SELECT book_id, ord, page, label FROM nodes), range(7) t(v)), totals AS (SELECT book_id || '-' || v AS book_id, CASE v WHEN 4 THEN (SELECT max(ord) FROM nodes n WHERE n.book_id = t.book_id) ELSE total END AS total FROM totals t, range(7) r(v))"""
GATED = GATED.replace("totals AS (SELECT book_id, max", "totals_ AS (SELECT book_id, max", 1).replace("FROM totals t", "FROM totals_ t")


def embedded_gate(spark, sf_dir):
    nodes, totals = _nodes(spark, sf_dir)
    last = nodes.groupBy("book_id").agg(F.max("ord").alias("last"))
    v = F.explode(F.sequence(F.lit(0), F.lit(6)))
    named = lambda df: df.withColumn("book_id", F.concat("book_id", F.lit("-"), F.col("v").cast("string")))
    page = F.when(F.col("v") == 4, F.col("ord")).when((F.col("v") == 5) & (F.col("ord") % 3 != 0), None).otherwise(F.col("page"))
    number = F.col("ord").cast("string")
    label = F.when(F.col("v") == 1, "same").when(F.col("v") == 2, number).when(F.col("v") == 3, F.concat(F.lit("未命名目录 "), number)).when(F.col("v") == 6, "  ").otherwise(F.col("label"))
    books = totals.join(last, "book_id").withColumn("v", v).withColumn("total", F.when(F.col("v") == 4, F.col("last")).otherwise(F.col("total")))
    return O.embedded_gate(named(nodes.withColumn("v", v).withColumn("page", page).withColumn("label", label)).drop("v"), named(books).select("book_id", "total"))


def toc_candidates(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents")).where("page <= 30").withColumn("has_index", F.col("text").contains(" | "))
    return O.toc_candidates(pages).select("book_id", F.col("page").cast("long").alias("page"))


def inherited_pages(spark, sf_dir):
    nodes, _ = _nodes(spark, sf_dir)
    return O.inherited_pages(nodes.withColumnRenamed("depth", "level")).select("book_id", "ord", "page")


def body_size(spark, sf_dir):
    lines = book_pages(table(spark, sf_dir, "documents")).select("book_id", F.length("text").cast("double").alias("size"))
    return O.body_size(lines).select("book_id", F.round("body", 6).alias("body"))


def level_tree(spark, sf_dir):
    nodes, _ = _nodes(spark, sf_dir)
    return O.level_tree(nodes.select("book_id", "ord", "label", F.col("depth").alias("level")))


DEEP = "CAST(1 + (ord * ord + ord // 3) % 12 AS INTEGER)"


def level_tree_deep(spark, sf_dir):
    """Levels from 1 to 12."""
    nodes, _ = _nodes(spark, sf_dir)
    return O.level_tree(nodes.select("book_id", "ord", "label", F.expr("cast(1 + (ord * ord + ord div 3) % 12 AS int)").alias("level")))


def _stacked(level: str) -> str:
    return f"""WITH RECURSIVE {PAGES}, {NODES}, l AS (SELECT book_id, CAST(ord AS BIGINT) AS ord, label, {level} AS level, row_number() OVER (PARTITION BY book_id ORDER BY ord) AS i FROM nodes),
s AS (SELECT book_id, i, ord, label, level, CAST(NULL AS BIGINT) AS parent, CAST(1 AS BIGINT) AS depth, [ord] AS stack FROM l WHERE i = 1
  UNION ALL SELECT l.book_id, l.i, l.ord, l.label, l.level, s.stack[1:greatest(l.level - 1, 0)][-1], len(s.stack[1:greatest(l.level - 1, 0)]) + 1, list_append(s.stack[1:greatest(l.level - 1, 0)], l.ord) FROM s JOIN l ON l.book_id = s.book_id AND l.i = s.i + 1)
SELECT book_id, ord, label, level, parent, CAST(depth AS INTEGER) AS depth FROM s"""


def title_keys(spark, sf_dir):
    h = _headings(spark, sf_dir)
    return h.select("doc_id", O.title_key(F.col("label")).alias("title_key"), H.explicit_level(F.col("label")).alias("level"), T.looks_like_heading(F.col("label")).alias("heading"))


RECTS = "s AS (SELECT s_suppkey AS selection_id, s_nationkey AS page, (s_suppkey * 37 % 80) / 100.0 AS l, (s_suppkey * 53 % 80) / 100.0 AS t FROM supplier), b AS (SELECT p_partkey AS block_id, p_partkey % 25 AS page, (p_partkey * 29 % 90) / 100.0 AS l, (p_partkey * 31 % 90) / 100.0 AS t, CASE p_size % 4 WHEN 0 THEN 'header' ELSE 'text' END AS type FROM part)"


def _rects(spark, sf_dir):
    s, b = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    at = lambda c, k, m: (F.col(c) * k % m) / 100.0
    sel = s.select(F.col("s_suppkey").alias("selection_id"), F.col("s_nationkey").cast("long").alias("page"), at("s_suppkey", 37, 80).alias("left"), at("s_suppkey", 53, 80).alias("top"))
    blk = b.select(F.col("p_partkey").alias("block_id"), (F.col("p_partkey") % 25).cast("long").alias("page"), at("p_partkey", 29, 90).alias("left"), at("p_partkey", 31, 90).alias("top"), F.when(F.col("p_size") % 4 == 0, "header").otherwise("text").alias("type"))
    wide = lambda df, w, h: df.withColumn("right", F.col("left") + w).withColumn("bottom", F.col("top") + h)
    return wide(sel, 0.15, 0.1), wide(blk, 0.08, 0.05)


def rect_overlap(spark, sf_dir):
    return G.overlapping(*_rects(spark, sf_dir))


def union_bbox(spark, sf_dir):
    box = G.union_box(_rects(spark, sf_dir)[1], ["page"])
    pixels = G.pixel_rect(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), F.lit(1000), F.lit(1400))
    return box.select("page", *[F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")], pixels["left"].cast("long").alias("x"), pixels["bottom"].cast("long").alias("y"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def trace_kinds(spark, sf_dir):
    lines = _events(spark, sf_dir).select(F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("kind"), F.col("props").alias("data"))).alias("value"))
    return E.kind_counts(traces(lines, list(TRACE_KINDS)))


def last_values(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", F.round("value", 6).alias("value"))
    return E.last_values(e, "10 minutes").select("key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "value")


def idle_sessions(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts")
    return E.idle_sessions(e, "30 minutes").select("key", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def roman(spark, sf_dir):
    """Numbers of pages in Roman numerals, read back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("I", "IV", "IX", "XIV", "XL", "XCIX", "CD", "MCMXC", "MMXXIV", "ABC"))), (F.col("p_partkey") % 10 + 1).cast("int")).alias("numeral"))
    return p.select("p_partkey", T.roman_numeral(F.col("numeral")).alias("value"))


QUERIES = {
    "retained_runs_by_budget": retained_runs, "elision_savings": elision, "conversation_replay": replay, "conversation_export": export, "evidence_top8": evidence,
    "inherited_evidence": inherited_evidence, "interrupted_messages": interrupted, "quota_reject": tool_quota, "job_queue_order": job_queue, "latest_job_per_kind": latest_jobs,
    "job_transition_validity": transitions, "job_transitions": job_changes, "reading_state_clamp": reading_state, "latest_wins_upsert": upsert, "cascade_delete": cascade, "covered_prefix": covered,
    "running_header_suppression": running_headers, "offset_vote": offset_vote, "chapter_range_asof": chapter_asof, "chapter_ranges": chapter_ranges, "section_range": section_range, "section_range_whole": section_range,
    "monotone_page_repair": monotone, "embedded_gate": embedded_gate, "toc_window_candidates": toc_candidates, "inherited_pages": inherited_pages, "body_font_median": body_size,
    "level_tree": level_tree, "level_tree_deep": level_tree_deep, "heading_candidates": title_keys, "rect_overlap_join": rect_overlap, "union_bbox": union_bbox, "trace_kind_counts": trace_kinds,
    "last_value_throttle": last_values, "idle_sessions": idle_sessions, "roman_numerals": roman,
}
ORACLE_SQL = {
    "retained_runs_by_budget": f"WITH {MSG}, {RET} SELECT session_id, run_id, tokens, retained FROM ret",
    "elision_savings": f"WITH {MSG}, {RET}, t AS (SELECT m.*, turn % 5 = 0 AS shown, {EST.format('body')} + CASE WHEN turn % 5 = 0 THEN 4000 ELSE 0 END AS cost, CASE WHEN turn % 5 = 0 THEN '第 ' || (turn + 1) || '、' || (turn + 2) || ' 页原图已省略，如需查看可调用 view_page 重新获取。' ELSE '此前 tool ' || turn || ' 结果约 ' || length(body) || ' 字符，已省略' END AS stub FROM m WHERE role <> 'user'), e AS (SELECT t.*, cost > 150 OR (NOT coalesce(retained, false) AND length(body) > 200) AS cut FROM t LEFT JOIN ret USING (session_id, run_id)) SELECT session_id, turn, cut AS elided, CASE WHEN cut THEN cost - {EST.format('stub')} ELSE 0 END AS saved, sha256(CASE WHEN cut THEN stub ELSE body END) AS body FROM e",
    "conversation_replay": f"WITH {MSG} SELECT session_id, turn, run_id, role, row_number() OVER (PARTITION BY session_id ORDER BY run_id, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 2 ELSE 1 END, turn) AS position FROM m WHERE run_id > 0 AND (role = 'user' OR trim(body) <> '')",
    "conversation_export": rf"""WITH {MSG}, x AS (SELECT *, CASE WHEN session_id % 4 <> 3 THEN TIMESTAMP '2024-01-30 20:00:00' + to_hours(CAST(turn * 2 AS INTEGER)) END AS told FROM m), s AS (SELECT DISTINCT session_id FROM m),
l AS (SELECT session_id, turn, told, (CASE role WHEN 'user' THEN '## 🧑 我' ELSE '## 🤖 AI' END) || chr(10) || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') || CASE WHEN role = 'user' AND turn % 4 = 0 THEN chr(10) || chr(10) || '> 📖 引用原文 · 第 ' || (turn + 1) || ' 页' WHEN role = 'assistant' AND turn % 3 = 1 THEN chr(10) || chr(10) || '> 📚 参考：第 ' || (turn + 2) || '、' || (turn + 15) || ' 页' ELSE '' END AS line FROM x WHERE role = 'user' OR (role = 'assistant' AND turn % 7 <> 3)),
g AS (SELECT session_id, count(*) AS n, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS body, strftime(min(told), '%Y-%m-%d') AS a, strftime(max(told), '%Y-%m-%d') AS b FROM l GROUP BY session_id)
SELECT session_id, coalesce(n, 0) AS n_messages, sha256('# 《' || CASE WHEN session_id % 5 = 0 THEN '未命名书籍' ELSE 'Book of ' || session_id END || '》阅读对话' || chr(10) || chr(10) || '> 导出自 pagelake · 2024-02-03' || coalesce(chr(10) || '> 对话时间：' || CASE WHEN a = b THEN a ELSE a || ' ~ ' || b END, '') || chr(10) || chr(10) || coalesce(body, '') || chr(10)) AS digest FROM s LEFT JOIN g USING (session_id)""",
    "evidence_top8": "WITH p AS (SELECT label AS answer_id, vec_id % 40 + 1 AS page, max(round(CAST(embedding[1] AS DOUBLE), 6)) AS score FROM embeddings GROUP BY ALL), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY score DESC, page) <= 8) SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY page) AS place FROM t",
    "inherited_evidence": f"WITH {MSG} SELECT session_id, turn, last_value(CASE WHEN length(body) % 3 = 0 THEN length(body) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS evidence FROM m",
    "interrupted_messages": f"WITH {MSG} SELECT session_id, turn, CASE role WHEN 'user' THEN 'cancelled' ELSE 'complete' END AS status FROM m QUALIFY turn = max(turn) OVER (PARTITION BY session_id)",
    "quota_reject": "SELECT event_type, CASE WHEN r <= 5 THEN 'executed' ELSE 'rejected' END AS outcome, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) GROUP BY ALL",
    "job_queue_order": f"WITH {JOBS} SELECT job_id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY priority DESC, created_at, job_id) AS position FROM jobs WHERE status = 'queued'",
    "level_tree": _stacked("CAST(depth AS INTEGER)"),
    "level_tree_deep": _stacked(DEEP),
    "latest_job_per_kind": f"WITH {ANY_JOBS} SELECT book_id, kind, job_id, status, CAST(list_position(['running', 'queued', 'paused', 'failed'], status) - 1 AS BIGINT) AS urgency FROM any_ WHERE status NOT IN ('completed', 'cancelled') QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY updated_at DESC, job_id DESC) = 1",
    "job_transitions": f"WITH {ANY_JOBS}, a AS (SELECT *, ['pause', 'resume', 'cancel'][job_id % 3 + 1] AS action FROM any_), o AS (SELECT *, (action <> 'resume' AND status IN ('queued', 'running', 'paused')) OR (action = 'resume' AND status IN ('paused', 'failed')) AS ok FROM a) SELECT job_id, ok, CASE WHEN NOT ok THEN status WHEN action = 'pause' THEN 'paused' WHEN action = 'resume' THEN 'queued' ELSE 'cancelled' END AS status, CASE WHEN ok AND action = 'resume' AND status = 'failed' THEN 0 ELSE job_id % 4 END AS attempts, CASE WHEN NOT (ok AND action = 'resume') THEN book_id END AS claim_id FROM o",
    "job_transition_validity": f"WITH {JOBS} SELECT job_id, action, (action = 'pause' AND status IN ('queued', 'running', 'paused')) OR (action = 'resume' AND status IN ('paused', 'failed')) OR (action = 'cancel' AND status IN ('queued', 'running', 'paused')) AS valid FROM (SELECT *, ['pause', 'resume', 'cancel'][job_id % 3 + 1] AS action FROM jobs)",
    "reading_state_clamp": "SELECT c_custkey, CAST(least(greatest(floor(c_acctbal), 1), 300) AS BIGINT) AS page, round(least(greatest(c_acctbal / 10, 25.0), 500.0), 6) AS zoom, round(greatest(0.0, c_acctbal), 6) AS scroll_top FROM customer",
    "latest_wins_upsert": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "cascade_delete": "SELECT source AS book_id, doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING sum(doc_id) % 3 = 0)",
    "covered_prefix": f"WITH {PAGES} SELECT book_id, coalesce(min(page) FILTER (length(text) < 120), max(page) + 1) - 1 AS prefix, count(*) AS pages FROM pages_ GROUP BY book_id",
    "running_header_suppression": f"WITH {PAGES}, {LABELS}, c AS (SELECT *, last_value(CASE WHEN doc_id % 5 = 0 THEN 1 + page % 12 END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS chapter FROM heads), k AS (SELECT book_id, page, lower(label) AS l, CASE doc_id % 5 WHEN 0 THEN 'c' || (1 + page % 12) WHEN 1 THEN 's' || coalesce(chapter, 0) || '.' || (1 + doc_id % 4) WHEN 2 THEN 's' || (1 + doc_id % 9) || '.' || (1 + doc_id % 8) END AS ordinal FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY book_id, l) AS n FROM k) SELECT book_id, page, ordinal FROM n QUALIFY row_number() OVER (PARTITION BY book_id, coalesce(ordinal, CASE WHEN n >= 3 THEN 'l' || l ELSE 'o' || page END) ORDER BY page) = 1",
    "offset_vote": f"WITH {PAGES}, v AS (SELECT book_id, CASE WHEN length(text) < 400 THEN 'toc' WHEN doc_id % 5 = 0 THEN 'anchor' ELSE 'body' END AS kind, CAST(page - floor(page * 0.9) AS BIGINT) AS o FROM pages_), c AS (SELECT book_id, o, count(*) FILTER (kind = 'anchor') AS a, count(*) FILTER (kind = 'body') AS b, count(*) FILTER (kind = 'toc') AS t FROM v GROUP BY ALL), w AS (SELECT book_id, (SELECT o FROM c x WHERE x.book_id = k.book_id AND a > 0 ORDER BY a DESC, a + b DESC, o LIMIT 1) AS ao, (SELECT a + b FROM c x WHERE x.book_id = k.book_id AND a > 0 ORDER BY a DESC, a + b DESC, o LIMIT 1) AS an, (SELECT o FROM c x WHERE x.book_id = k.book_id AND b > 0 ORDER BY b DESC, a + b DESC, o LIMIT 1) AS bo, (SELECT a + b FROM c x WHERE x.book_id = k.book_id AND b > 0 ORDER BY b DESC, a + b DESC, o LIMIT 1) AS bn, (SELECT o FROM c x WHERE x.book_id = k.book_id AND t > 0 ORDER BY t DESC, o LIMIT 1) AS \"to\", (SELECT t FROM c x WHERE x.book_id = k.book_id AND t > 0 ORDER BY t DESC, o LIMIT 1) AS tn FROM (SELECT DISTINCT book_id FROM c) k) SELECT book_id, CASE WHEN an >= 2 THEN ao WHEN bn >= 2 THEN bo WHEN tn >= 2 THEN \"to\" END AS page_offset, CASE WHEN an >= 2 THEN 'anchor' WHEN bn >= 2 THEN 'body' WHEN tn >= 2 THEN 'toc' END AS basis FROM w",
    "chapter_range_asof": f"WITH {PAGES}, {NODES} SELECT n.book_id, n.ord * 3 + 1 AS page, (SELECT max(x.page) FROM nodes x WHERE x.book_id = n.book_id AND x.depth = 1 AND x.page <= n.ord * 3 + 1) AS start FROM nodes n",
    "chapter_ranges": f"WITH {PAGES}, {NODES} SELECT book_id, s AS start, coalesce(lead(s) OVER (PARTITION BY book_id ORDER BY s) - 1, total) AS \"end\" FROM (SELECT DISTINCT book_id, page AS s FROM nodes WHERE depth = 1 AND page IS NOT NULL) JOIN totals USING (book_id)",
    "section_range": f"WITH {PAGES}, {NODES}, n AS (SELECT * FROM nodes), p AS (SELECT a.*, (SELECT min(b.ord) FROM n b WHERE b.book_id = a.book_id AND b.ord > a.ord AND b.depth <= a.depth) AS past FROM n a), r AS (SELECT p.book_id, p.ord, p.depth, (SELECT arg_min(x.page, x.ord) FROM n x WHERE x.book_id = p.book_id AND x.page IS NOT NULL AND x.ord >= p.ord AND (p.past IS NULL OR x.ord < p.past)) AS start FROM p), k AS (SELECT * FROM r WHERE start IS NOT NULL) SELECT k.book_id, k.ord, k.start, greatest(k.start, coalesce((SELECT arg_min(y.start, y.ord) FROM k y WHERE y.book_id = k.book_id AND y.ord > k.ord AND y.depth <= k.depth) - 1, total)) AS \"end\" FROM k JOIN totals USING (book_id)",
    "section_range_whole": f"WITH {PAGES}, {NODES}, n AS (SELECT * FROM nodes), p AS (SELECT a.*, (SELECT min(b.ord) FROM n b WHERE b.book_id = a.book_id AND b.ord > a.ord AND b.depth <= a.depth) AS past FROM n a), r AS (SELECT p.book_id, p.ord, p.depth, (SELECT arg_min(x.page, x.ord) FROM n x WHERE x.book_id = p.book_id AND x.page IS NOT NULL AND x.ord >= p.ord AND (p.past IS NULL OR x.ord < p.past)) AS start FROM p), k AS (SELECT * FROM r WHERE start IS NOT NULL) SELECT k.book_id, k.ord, k.start, greatest(k.start, coalesce((SELECT arg_min(y.start, y.ord) FROM k y WHERE y.book_id = k.book_id AND y.ord > k.ord AND y.depth <= k.depth) - 1, total)) AS \"end\" FROM k JOIN totals USING (book_id)",
    "monotone_page_repair": f"WITH {PAGES}, {NODES} SELECT book_id, ord, CASE WHEN page IS NOT NULL THEN max(page * 7 % 50) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS page FROM nodes",
    "embedded_gate": f"WITH {PAGES}, {GATED}, x AS (SELECT g.*, total, CASE WHEN page BETWEEN 1 AND total THEN page END AS ok FROM gated g JOIN totals USING (book_id)), y AS (SELECT *, ok - last_value(ok IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM x), g AS (SELECT book_id, total, count(*) AS n, count(ok) AS r, count(DISTINCT ok) AS pages, count(DISTINCT trim(label)) FILTER (trim(label) <> '') AS labels, count(*) FILTER (trim(label) <> '' AND NOT regexp_matches(trim(label), '^[0-9]+$')) AS words, count(*) FILTER (trim(label) <> '' AND NOT starts_with(trim(label), '未命名')) AS named, count(*) FILTER (step <> 1) AS jumps FROM y GROUP BY ALL) SELECT book_id, n >= 3 AND r >= 2 AND r / n >= 0.5 AND pages >= 2 AND labels > 1 AND words > 0 AND named > 0 AND NOT (r >= greatest(3, total) AND jumps = 0) AS accepted FROM g",
    "toc_window_candidates": f"WITH {PAGES}, h AS (SELECT book_id, page FROM pages_ WHERE page <= 30 AND contains(text, ' | ')) SELECT DISTINCT book_id, unnest(range(greatest(1, page - 1), page + 2)) AS page FROM h",
    "inherited_pages": f"WITH {PAGES}, {NODES}, w AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(page IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM nodes) SELECT book_id, ord, CASE WHEN depth = 1 THEN coalesce(page, f, b) ELSE coalesce(page, b, f) END AS page FROM w",
    "body_font_median": f"WITH {PAGES}, r AS (SELECT book_id, length(text) AS size, row_number() OVER (PARTITION BY book_id ORDER BY length(text)) AS r, count(*) OVER (PARTITION BY book_id) AS n FROM pages_) SELECT book_id, round(quantile_cont(CAST(size AS DOUBLE), 0.5), 6) AS body FROM r WHERE r <= greatest(1, floor(0.75 * n)) GROUP BY book_id",
    "heading_candidates": rf"WITH {PAGES}, {LABELS}, t AS (SELECT doc_id, label, CASE WHEN doc_id % 5 < 3 AND string_split(text, chr(10))[1] <> '' THEN string_split(text, chr(10))[1] ELSE label END AS title FROM heads JOIN documents USING (doc_id)), k AS (SELECT *, regexp_replace(lower(regexp_replace(CASE WHEN doc_id % 5 < 2 THEN regexp_replace(title, '^([1-9][0-9]?\s*[.．]\s*[1-9][0-9]{{0,2}}\s+)?', '') ELSE title END, '^[1-9][0-9]?\s*\*?\s*[\s.．]?\s*', '')), '[^a-z0-9一-鿿]', '', 'g') AS k FROM t) SELECT doc_id, CASE WHEN length(k) >= 2 THEN k END AS title_key, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 END AS level, doc_id % 5 IN (0, 2) AND length(trim(label)) <= 80 AS heading FROM k",
    "rect_overlap_join": f"WITH {RECTS} SELECT selection_id, block_id, type = 'header' AS noise FROM s JOIN b USING (page) WHERE CAST(s.l AS DOUBLE) < CAST(b.l AS DOUBLE) + 0.08::DOUBLE AND CAST(b.l AS DOUBLE) < CAST(s.l AS DOUBLE) + 0.15::DOUBLE AND CAST(s.t AS DOUBLE) < CAST(b.t AS DOUBLE) + 0.05::DOUBLE AND CAST(b.t AS DOUBLE) < CAST(s.t AS DOUBLE) + 0.1::DOUBLE",
    "union_bbox": f"WITH {RECTS}, u AS (SELECT page, min(l::DOUBLE) AS x0, min(t::DOUBLE) AS y0, max(l::DOUBLE + 0.08::DOUBLE) AS x1, max(t::DOUBLE + 0.05::DOUBLE) AS y1 FROM b GROUP BY page) SELECT page, round(x0, 6) AS \"left\", round(y0, 6) AS top, round(x1, 6) AS \"right\", round(y1, 6) AS bottom, CAST(least(greatest(floor(x0 * 1000), 0), 1000) AS BIGINT) AS x, CAST(least(greatest(ceil(y1 * 1400), 0), 1400) AS BIGINT) AS y FROM u",
    "trace_kind_counts": "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'logout', 'error') GROUP BY 1",
    "last_value_throttle": "SELECT user_id AS key, time_bucket(INTERVAL '10 minutes', ts) AS window_start, round(arg_max(value, (epoch_us(ts), event_id)), 6) AS value FROM events GROUP BY ALL",
    "idle_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id AS key, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM n GROUP BY user_id, s",
    "roman_numerals": "SELECT p_partkey, [1, 4, 9, 14, 40, 99, 400, 1990, 2024, NULL][p_partkey % 10 + 1] AS value FROM part",
}
