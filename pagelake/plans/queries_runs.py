"""Queries over runs, traces and lookups, seen in the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import headings, runs, search, state
from ..sources.tables import book_pages, few, messages, table
from .queries_state import MSG, NODES, PAGES, _nodes


def pages_found(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents"))
    wanted = pages.select("book_id", (F.col("page") * 2).cast("int").alias("page"))
    return runs.found_and_missing(wanted, pages).select("book_id", F.col("page").cast("long").alias("page"), "found")


def spine(spark, sf_dir):
    return runs.increasing(_nodes(spark, sf_dir)[0])


def yield_probe(spark, sf_dir):
    """A page is scanned if it has some text; a book's pages up to the first without are its scanned ones."""
    pages = book_pages(table(spark, sf_dir, "documents")).where("text IS NOT NULL")
    books = state.covered_prefix(pages.select("book_id", "page", (F.length("text") >= 120).alias("covered"))).select("book_id", F.col("pages").alias("total"), F.col("prefix").alias("scanned"))
    return runs.yields(pages.select("book_id", "page", F.col("text").contains(" | ").alias("has_index")), books)


def native_majority(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents"))
    return pages.groupBy("book_id").agg((F.count_if(F.length("text") >= 16) >= F.ceil(F.count("*") / 2)).alias("native"), F.bool_and(F.trim("text") != "").alias("all_have_text"))


def label_pages(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents")).select("book_id", "page", F.lower(F.trim(F.split("text", "\n")[0])).alias("label"))
    return pages.groupBy("book_id", "label").agg(F.count_distinct("page").alias("n")).where("n >= 2")


def strong_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), "vec_id", F.round(F.col("embedding")[1].cast("double"), 6).alias("score"))
    return search.strong(hits, ["query_id"])


def cosine_to_first(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(few(first), "label").select("vec_id", F.round(T.cosine(F.col("first"), F.col("embedding")), 6).alias("cosine"), F.sha2(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ","), 256).alias("digest"))


def checkpoints(spark, sf_dir):
    """Part prices less a thousand as pages done, so some are negative and most broken numbers; and what others left."""
    c = table(spark, sf_dir, "part").select("p_partkey", "p_size", runs.checkpoint(F.col("p_retailprice") - 1000).alias("checkpoint"))
    other = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("checkpoint"), F.lit("x"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("ocr:"), "p_size", F.lit("/9")))
    return c.select("p_partkey", "checkpoint", runs.checkpoint_prefix(F.col("checkpoint")).alias("prefix"), runs.checkpoint_prefix(other).alias("broken"))


def exit_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("rounds"), F.count_if(F.col("event_type") == "logout").alias("l"), F.count_if(F.col("event_type") == "error").alias("x"), F.max("value").alias("v"))
    failure = F.when(F.col("l") % 5 == 0, "cancelled").when(F.col("x") % 5 == 0, "error")
    trigger = F.when(F.col("rounds") % 7 == 0, "max_iterations").when(F.col("rounds") % 7 == 1, "loop_detected").when(F.col("rounds") % 7 == 2, "wall_clock_total").when(F.col("rounds") % 7 == 3, "wall_clock_idle")
    return e.select("user_id", runs.exit_reason(F.col("rounds") % 11 == 0, failure, trigger, F.col("v") > 300).alias("reason"))


def late_results(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type", "value")
    kept = runs.without_late(e, e.where("event_type = 'purchase' AND value > 20").select("key", "ts"))
    return kept.groupBy("key").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def image_quota(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("images"))
    return runs.spent(e, "images", ["user_id"], ["ts", "event_id"], 3).groupBy("allowed").agg(F.count("*").alias("n"), F.sum("images").alias("images"))


def last_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return runs.last_of(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id")


def questions(spark, sf_dir):
    return runs.question_of(messages(table(spark, sf_dir, "conversations")))


def tool_names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("book_search", "read_page_image", "web_search", "read_outline"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", runs.current_name(name).alias("tool"))


def reference_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list((F.col("event_id") % 23).cast("int")).alias("p"))
    pages = F.array_sort(F.array_distinct("p"))
    return e.select("user_id", F.array_join(pages, ",").alias("pages"), F.size(F.array_except(F.sequence(F.lit(0), F.lit(22)), "p")).cast("long").alias("missing"))


def outline_replies(spark, sf_dir):
    entry = F.struct(F.substring("text", 1, 30).alias("label"), (F.col("doc_id") % 5).cast("int").alias("level"), (F.col("doc_id") * 37 % 12000).cast("int").alias("printed"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(entry).alias("entries"))), F.lit("\n```"))
    made = table(spark, sf_dir, "documents").select("doc_id", runs.outline_entries(reply).alias("e"))
    return made.select("doc_id", F.size("e").cast("long").alias("n"), F.get("e", F.lit(0))["level"].alias("level"))


def toc_anchors(spark, sf_dir):
    pages = book_pages(table(spark, sf_dir, "documents"))
    heads = pages.select("book_id", "page", F.col("page").alias("ord"), F.concat(F.lit("c"), (F.col("doc_id") % 30).cast("string")).alias("ordinal"), F.concat(F.lit("t"), (F.col("doc_id") % 17).cast("string")).alias("title_key"))
    rows = pages.select("book_id", F.col("page").cast("long").alias("ord"), F.concat(F.lit("c"), F.col("page").cast("string")).alias("ordinal"), F.concat(F.lit("t"), (F.col("page") % 20).cast("string")).alias("title_key"))
    return runs.anchored(rows, heads).select("book_id", "ord", F.col("page").cast("long").alias("page"))


def formulas(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(\$\$[^$]+\$\$|\$[^$\n]+\$)"), F.lit(1))).cast("long").alias("n"))


def date_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("b"))
    return e.select("user_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws(" – ", "a", "b")).alias("range"))


def moved_texts(spark, sf_dir):
    """Which first copy each document's bytes belong to: a new path counts only if the digest is known."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.join(d.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "digest").select("doc_id", "first_id")


def fenced_writes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    claims = o.select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 3).alias("claim_id"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("running").alias("status"))
    writes = o.select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 3).alias("claim_id"), F.floor(F.col("o_totalprice") - 1000).cast("long").alias("progress"), F.lit(90000).cast("long").alias("total"))
    return runs.fenced(writes, claims).select("job_id", "progress")


def section_headings(spark, sf_dir):
    """Dotted labels: their ordinal and level."""
    label = F.concat((F.col("p_size") % 9).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(".3")).otherwise(""), F.lit(" "), F.col("p_name"))
    o = headings.ordinal(label)
    made = F.concat(F.lit("s"), o["scope"].cast("string"), F.lit("."), o["number"].cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("ordinal"), headings.explicit_level(label).alias("level"))


QUERIES = {
    "pages_found_missing": pages_found, "spine_increasing": spine, "outline_yield_probe": yield_probe, "native_majority": native_majority, "label_pages": label_pages,
    "strong_hit_cutoff": strong_hits, "cosine_similarity": cosine_to_first, "ocr_checkpoint_codec": checkpoints, "exit_reason": exit_reasons, "late_results_dropped": late_results,
    "image_quota": image_quota, "diagnostics_last_runs": last_runs, "retry_question": questions, "tool_alias_map": tool_names, "reference_pages": reference_pages,
    "outline_reply_parse": outline_replies, "toc_anchor_lookup": toc_anchors, "formula_count": formulas, "conversation_date_range": date_ranges, "relocate_by_hash": moved_texts,
    "fenced_checkpoint_writes": fenced_writes, "section_ordinals": section_headings,
}
ORACLE_SQL = {
    "pages_found_missing": f"WITH {PAGES} SELECT a.book_id, a.page * 2 AS page, b.page IS NOT NULL AS found FROM pages_ a LEFT JOIN pages_ b ON b.book_id = a.book_id AND b.page = a.page * 2",
    "spine_increasing": f"WITH {PAGES}, {NODES}, s AS (SELECT book_id, page - lag(page) OVER (PARTITION BY book_id ORDER BY ord) AS step FROM nodes WHERE depth = 1 AND page IS NOT NULL) SELECT book_id, coalesce(bool_and(step > 0), true) AS increasing FROM s GROUP BY book_id",
    "outline_yield_probe": f"WITH {PAGES}, b AS (SELECT book_id, count(*) AS total, coalesce(min(page) FILTER (length(text) < 120) - 1, max(page)) AS scanned FROM pages_ GROUP BY book_id), p AS (SELECT pages_.book_id, page, contains(text, ' | ') AS has_index, scanned FROM pages_ JOIN b USING (book_id) WHERE page <= least(total, 30)), l AS (SELECT *, max(CASE WHEN has_index THEN page END) OVER (PARTITION BY book_id) AS li FROM p), c AS (SELECT book_id, count(*) FILTER (page BETWEEN li + 1 AND li + 2 AND page <= scanned AND NOT has_index) AS clear FROM l GROUP BY book_id) SELECT book_id, scanned >= least(total, 30) OR clear = 2 AS yields FROM b JOIN c USING (book_id)",
    "native_majority": "SELECT source AS book_id, count(*) FILTER (length(text) >= 16) >= ceil(count(*) / 2) AS native, bool_and(trim(text) <> '') AS all_have_text FROM documents GROUP BY 1",
    "label_pages": "SELECT source AS book_id, lower(trim(string_split(text, chr(10))[1])) AS label, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 2",
    "strong_hit_cutoff": "SELECT query_id, vec_id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM (SELECT label AS query_id, vec_id, round(CAST(embedding[2] AS DOUBLE), 6) AS score FROM embeddings)) WHERE top <= 0 OR score >= top * 0.6",
    "cosine_similarity": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label) SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(first::DOUBLE[], embedding::DOUBLE[]))), 6) AS cosine, sha256(array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ',')) AS digest FROM embeddings JOIN f USING (label)",
    "ocr_checkpoint_codec": "SELECT p_partkey, 'ocr-linear:' || greatest(0, CAST(floor(p_retailprice - 1000) AS BIGINT)) AS checkpoint, greatest(0, CAST(floor(p_retailprice - 1000) AS BIGINT)) AS prefix, CAST(0 AS BIGINT) AS broken FROM part",
    "exit_reason": "SELECT user_id, CASE WHEN count(*) % 11 = 0 THEN 'all_retries_exhausted_no_response' WHEN count(*) FILTER (event_type = 'logout') % 5 = 0 THEN 'interrupted_by_user' WHEN count(*) FILTER (event_type = 'error') % 5 = 0 THEN 'error' WHEN count(*) % 7 < 4 THEN ['max_iterations_reached', 'loop_detected', 'wall_clock_timeout', 'wall_clock_timeout'][count(*) % 7 + 1] WHEN coalesce(max(value) <= 300, true) THEN 'unknown' ELSE 'completed' END AS reason FROM events GROUP BY user_id",
    "late_results_dropped": "WITH c AS (SELECT user_id, min(ts) AS c FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY 1) SELECT user_id AS key, count(*) AS n, max(event_id) AS last_id FROM events LEFT JOIN c USING (user_id) WHERE c IS NULL OR ts <= c GROUP BY user_id",
    "image_quota": "WITH r AS (SELECT CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS i, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 3 AS allowed FROM events) SELECT allowed, count(*) AS n, sum(i) AS images FROM r GROUP BY allowed",
    "diagnostics_last_runs": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5",
    "retry_question": f"WITH {MSG} SELECT session_id, turn, question_turn FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question_turn FROM m) WHERE role = 'assistant'",
    "tool_alias_map": "SELECT p_partkey, ['search_book', 'view_page', 'search_web', 'read_outline'][p_partkey % 4 + 1] AS tool FROM part",
    "reference_pages": "SELECT user_id, string_agg(DISTINCT p, ',' ORDER BY p) AS pages, 23 - count(DISTINCT p) AS missing FROM (SELECT user_id, event_id % 23 AS p FROM events) GROUP BY user_id",
    "outline_reply_parse": "SELECT doc_id, CASE WHEN ok THEN 1 ELSE 0 END AS n, CASE WHEN ok THEN doc_id % 5 END AS level FROM (SELECT doc_id, length(trim(substring(text, 1, 30))) BETWEEN 2 AND 80 AND doc_id % 5 BETWEEN 1 AND 3 AND doc_id * 37 % 12000 <= 9999 AS ok FROM documents)",
    "toc_anchor_lookup": f"WITH {PAGES} SELECT a.book_id, a.page AS ord, coalesce((SELECT min(page) FROM pages_ b WHERE b.book_id = a.book_id AND b.doc_id % 30 = a.page), (SELECT min(page) FROM pages_ b WHERE b.book_id = a.book_id AND b.doc_id % 17 = a.page % 20)) AS page FROM pages_ a",
    "formula_count": r"SELECT doc_id, len(regexp_extract_all(text, '\$\$[^$]+\$\$|\$[^$\n]+\$')) AS n FROM documents",
    "conversation_date_range": "SELECT user_id, CASE WHEN a = b THEN a ELSE a || ' – ' || b END AS range FROM (SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS a, strftime(max(ts), '%Y-%m-%d') AS b FROM events GROUP BY user_id)",
    "relocate_by_hash": "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents",
    "fenced_checkpoint_writes": "SELECT o_orderkey AS job_id, least(greatest(CAST(floor(o_totalprice - 1000) AS BIGINT), 0), 90000) AS progress FROM orders WHERE o_custkey % 3 = o_orderkey % 3 AND o_orderstatus <> 'P'",
    "section_ordinals": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 AND p_size % 9 > 0 AND p_partkey % 7 > 0 THEN 's' || (p_size % 9) || '.' || (p_partkey % 7) END AS ordinal, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS level FROM part",
}
