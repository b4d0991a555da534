"""Rules of names, checkpoints, run ends, job states, stubs and stream lines, by rows with stated results."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.functions import parsers as P
from pagelake.operators import conversation, outline, runs, state
from pagelake.streaming import events


def column(spark, fn, kind, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_retired_tool_names(spark):
    assert column(spark, runs.current_name, "string", "book_search", "read_page_image", "web_search", "read_outline", None) == ["search_book", "view_page", "search_web", "read_outline", None]


def test_checkpoints(spark):
    assert column(spark, runs.checkpoint, "double", 12.0, 7.9, -3.0, None, float("nan")) == ["ocr-linear:12", "ocr-linear:7", "ocr-linear:0", "ocr-linear:0", "ocr-linear:0"]
    texts = ["ocr-linear:12", "ocr-order:6:12", "start:9", "ocr-linear:", "ocr-linear:3\n", " ocr-linear:3", "", None, "ocr-linear:0"]
    assert column(spark, runs.checkpoint_prefix, "string", *texts) == [12, 0, 0, 0, 0, 0, 0, 0, 0]


def test_run_ends(spark):
    rows = [(True, "cancelled", "loop_detected", True), (False, "cancelled", "loop_detected", True), (False, "error", None, False), (False, None, "max_iterations", True), (False, None, "loop_detected", False),
            (False, None, "wall_clock_total", False), (False, None, "wall_clock_idle", True), (False, None, None, False), (False, None, None, None), (False, None, None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e boolean, f string, t string, a boolean").orderBy("i")
    assert [r[0] for r in df.select(runs.exit_reason(*map(F.col, "efta"))).collect()] == [
        "all_retries_exhausted_no_response", "interrupted_by_user", "error", "max_iterations_reached", "loop_detected",
        "wall_clock_timeout", "wall_clock_timeout", "unknown", "unknown", "completed"]


def test_job_states(spark):
    states = ["queued", "running", "paused", "failed", "completed", "cancelled"]
    jobs = spark.createDataFrame([(f"{a} {s}", a, s, 2, "me") for a in ("pause", "resume", "cancel", None) for s in states], "k string, action string, status string, attempts int, claim_id string")
    found = {r["k"]: (r["ok"], r["status"], r["attempts"], r["claim_id"]) for r in state.transitioned(jobs).collect()}
    changed = {"pause queued": "paused", "pause running": "paused", "pause paused": "paused", "cancel queued": "cancelled", "cancel running": "cancelled", "cancel paused": "cancelled"}
    for k, was in found.items():
        if k == "resume paused":
            assert was == (True, "queued", 2, None)
        elif k == "resume failed":
            assert was == (True, "queued", 0, None)
        else:
            assert was == ((True, changed[k], 2, "me") if k in changed else (False, k.split(" ")[1], 2, "me"))


def test_live_jobs_show(spark):
    """A newer job that is over hides none; the most urgent is 0."""
    rows = [(1, "b", "ocr", "running", 1), (2, "b", "ocr", "completed", 9), (3, "b", "index", "failed", 3), (4, "b", "index", "queued", 2), (5, "b", "outline", "cancelled", 1)]
    jobs = spark.createDataFrame(rows, "job_id int, book_id string, kind string, status string, updated_at int")
    assert sorted((r["job_id"], r["urgency"]) for r in state.latest_per_kind(jobs).collect()) == [(1, 0), (3, 3)]


def test_stubs(spark):
    rows = [("s", 1, "检索本书", "x" * 300, []), ("s", 2, "读取页面", "长文本" * 700, []), ("s", 2, "看图", "", [1, 2]), ("s", 2, "短", "y" * 300, []), ("s", 1, "短", "z" * 200, None), ("t", 1, "无", None, None)]
    tools = spark.createDataFrame(rows, "session_id string, run_id int, title string, body string, media_pages array<int>")
    kept = spark.createDataFrame([("s", 1, False), ("s", 2, True)], "session_id string, run_id int, retained boolean")
    found = {(r["title"], r["run_id"]): (r["elided"], r["body"]) for r in conversation.elided(tools, kept, 2000).collect()}
    assert found == {
        ("检索本书", 1): (True, "此前 检索本书 结果约 300 字符，已省略"), ("读取页面", 2): (True, "此前 读取页面 结果约 2100 字符，已省略"),
        ("看图", 2): (True, "第 1、2 页原图已省略，如需查看可调用 view_page 重新获取。"), ("短", 2): (False, "y" * 300), ("短", 1): (False, "z" * 200), ("无", 1): (False, None)}


def test_reasoning_goes_and_all_else_stays(spark):
    chunk = lambda delta: {"id": "c1", "object": "chat.completion.chunk", "choices": [{"index": 0, "delta": delta, "finish_reason": None}]}
    hidden = {"reasoning_content": "思考", "reasoning": "思考", "reasoning_text": "思考", "reasoning_details": [{"type": "reasoning.text", "text": "思考"}]}
    calls = {"tool_calls": [{"index": 0, "id": "t1", "type": "function", "function": {"name": "f", "arguments": '{"a": 1}'}}], "content": None}
    told = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    texts = [told(chunk({"content": "正文", **hidden})), told(chunk({"content": "正文"})), "[DONE]", told({"type": "content_block_delta", "delta": {"reasoning": "x"}}), told({"choices": [{"index": 0}]}),
             told({"model": "m", **chunk({**hidden, **calls}), "usage": {"total": 3, "reasoning": 2}}), '{"choices":[{"delta":{"reasoning":1}}],"n":1.50,"big":12345678901234567890,"e":1e-7}', "{broken reasoning", None, '["reasoning"]', '{"choices":[null,{"delta":[]},{"delta":{"reasoning":[]}}]}']
    assert column(spark, P.without_reasoning, "string", *texts) == [
        told(chunk({"content": "正文"})), None, None, None, None, told({"model": "m", **chunk(calls), "usage": {"total": 3, "reasoning": 2}}),
        '{"choices":[{"delta":{}}],"n":1.50,"big":12345678901234567890,"e":1e-7}', None, None, None, '{"choices":[null,{"delta":[]},{"delta":{}}]}']
    lines = [f"  data: {texts[0]}  ", f"data:{texts[1]}", "event: x", "data:", "", ": reasoning"]
    assert column(spark, P.stream_line, "string", *lines) == [f"data: {told(chunk({'content': '正文'}))}", *lines[1:]]


def test_results_are_decoded(spark):
    html = '<a class="result__a" href="/l/?uddg=https%3A%2F%2Fx.y">Q&amp;A <b>b</b>old</a><a class="result__snippet">1 &lt; 2 &#38; 3</a><a href="//d.d/l/?uddg=https%3A%2F%2Fz.z%2F%3Fa%3D1&amp;rut=2" class="x result__a">T</a><a class="result__a" href="https://p.q/?a=1&amp;b=2">U</a>'
    found = column(spark, P.result_links, "string", html)[0]
    assert [tuple(r) for r in found] == [("Q&A bold", "/l/?uddg=https%3A%2F%2Fx.y", "1 < 2 & 3"), ("T", "https://z.z/?a=1", ""), ("U", "https://p.q/?a=1&b=2", "")]


@pytest.mark.parametrize(("label", "key"), [("窃(qiè)读记", "窃读记"), ("Calculus (Second Edition)", "calculussecondedition"), ("窃（qiè）读记", "窃qi读记"), ("Notes (abcdefghi)", "notesabcdefghi")])
def test_only_short_lower_case_notes_go(spark, label, key):
    assert column(spark, outline.title_key, "string", label) == [key]


def test_words_without_marks(spark):
    from pagelake.functions import text as T

    found = column(spark, T.word_tokens, "string", "Café CAFÉ cafe", "ÑANDÚ ñandu", "İstanbul Ünïcödé", "Ελλάδα йод łódź", "日本 が")
    assert found == [["cafe", "cafe", "cafe"], ["nandu", "nandu"], ["istanbul", "unicode"], ["ελλαδα", "иод", "łodz"], ["日", "本", "が"]]


def test_exported_conversation(spark):
    rows = [(1, 2, "assistant", "complete", "  Because.\n", None, [7, 3, 7], "2024-05-02 09:00:00"), (1, 1, "user", None, "Why?", 4, None, "2024-05-01 23:00:00"), (1, 3, "assistant", "failed", "x", None, [1], "2024-06-01 00:00:00"), (1, 4, "user", None, "And?", None, None, None), (2, 1, "assistant", "cancelled", "y", None, None, "2024-05-01 00:00:00")]
    said = spark.createDataFrame(rows, "session_id int, turn int, role string, status string, body string, passage_page int, evidence_pages array<int>, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    titles = spark.createDataFrame([(1, " A\r\nBook\t"), (2, " \n"), (3, None)], "session_id int, title string")
    found = {r["session_id"]: (r["n_messages"], r["markdown"]) for r in conversation.exported(said, titles, F.lit("2024-06-07").cast("date"), "me").collect()}
    assert found == {
        1: (3, "# 《A Book》阅读对话\n\n> 导出自 me · 2024-06-07\n> 对话时间：2024-05-01 ~ 2024-05-02\n\n## 🧑 我\n\nWhy?\n\n> 📖 引用原文 · 第 4 页\n\n## 🤖 AI\n\nBecause.\n\n> 📚 参考：第 3、7 页\n\n## 🧑 我\n\nAnd?\n"),
        2: (0, "# 《未命名书籍》阅读对话\n\n> 导出自 me · 2024-06-07\n\n\n"), 3: (0, "# 《未命名书籍》阅读对话\n\n> 导出自 me · 2024-06-07\n\n\n")}


def test_contents_are_over(spark):
    books = [("none", 0, 0), ("short", 3, 3), ("half", 9, 2), ("behind", 90, 7), ("unseen", 90, 6), ("index", 90, 29), ("edge", 90, 29), ("whole", 90, 30)]
    index = {"half": [1], "behind": [2, 5], "unseen": [5], "index": [27, 29], "edge": [29]}
    probe = [(b, p, p in index.get(b, [])) for b, total, _ in books for p in range(1, min(total, 40) + 1)]
    found = runs.yields(spark.createDataFrame(probe, "book_id string, page int, has_index boolean"), spark.createDataFrame(books, "book_id string, total int, scanned int"))
    assert {r["book_id"]: r["yields"] for r in found.collect()} == {"none": False, "short": True, "half": False, "behind": True, "unseen": False, "index": False, "edge": False, "whole": True}


def plain_settled(text):
    spans, opened, at = [], None, 0
    for line in text.split("\n"):
        m = re.match(r"^ {0,3}(`{3,}|~{3,})(.*)$", line)
        if m and opened is None and not (m[1][0] == "`" and "`" in m[2]):
            opened = (at, m[1])
        elif m and opened and m[1][0] == opened[1][0] and len(m[1]) >= len(opened[1]) and not m[2].strip():
            spans.append((opened[0], at + len(line)))
            opened = None
        at += len(line) + 1
    if opened:
        spans.append((opened[0], len(text)))
    index = text.rfind("\n\n")
    while index >= 0:
        if not any(a < index + 1 < b for a, b in spans) and text[: index + 2].count("$$") % 2 == 0:
            return index + 2
        index = text.rfind("\n\n", 0, index + 1)
    return 0


def test_settled_markdown(spark):
    """Of texts cut anywhere, as by a plain reading of the whole."""
    from pagelake.functions import text as T

    whole = "One *two*\n\nthree\n\n\n```py\na\n\n``\n~~~\n\n```\n\n$$x\n\ny$$\n\n- a\n\n- b\n~~~~ a`b\n\n~~~\n\n~~~~  \n\nend $$$$ $$\n\nopen\n\n$$ done\n\n````\n\n"
    texts = [whole[:n] for n in range(len(whole) + 1)] + ["\n\n", "\n\n\n", "a\n", "``` `x\n\n", None]
    found = column(spark, T.settled_length, "string", *texts)
    assert found == [plain_settled(t) for t in texts[:-1]] + [None] and len(set(found)) > 8


def test_runs_of_numbers():
    rng = random.Random(1)
    for _ in range(300):
        have, more = set(rng.sample(range(30), rng.randint(0, 20))), sorted(rng.sample(range(30), rng.randint(0, 10)))
        runs_of = lambda s: [(a, max(b for b in range(a, 31) if set(range(a, b + 1)) <= s)) for a in sorted(s) if a - 1 not in s]
        before = runs_of(have)
        a, b = events.merged_runs(np.array([x for x, _ in before], np.int64), np.array([x for _, x in before], np.int64), np.array(more, np.int64))
        assert list(zip(a.tolist(), b.tolist())) == runs_of(have | set(more))


def test_files_of_books(spark, tmp_path):
    """PDF files anywhere below a path, by the digest of their bytes; other files and empty ones are none."""
    import hashlib

    from pagelake.sources import tables

    (tmp_path / "deep" / "er").mkdir(parents=True)
    kept = {"a.pdf": b"%PDF one", "deep/B.PDF": b"%PDF two", "deep/er/copy.pdf": b"%PDF one"}
    for name, data in {**kept, "deep/empty.Pdf": b"", "notes.txt": b"%PDF", "deep/pdf": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = tables.book_files(spark, str(tmp_path)).collect()
    assert sorted((r["path"].split(str(tmp_path) + "/")[1], r["book_id"], r["bytes"]) for r in rows) == sorted((n, hashlib.sha256(d).hexdigest(), len(d)) for n, d in kept.items())
