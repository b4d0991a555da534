import json

from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.operators import chunker, outline, search, state
from pagelake.sources.tables import traces
from pagelake.streaming import events


def column(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cjk_tokens_and_terms(spark):
    assert column(spark, T.index_tokens, "电子能量energy", "Chapter One") == ["电 子 能 量 energy", "Chapter One"]
    assert column(spark, T.search_terms, "请假 审批 年假", "a，b、c;d", "x x", " , ") == [["请假", "审批", "年假"], ["a", "b", "c", "d"], ["x"], []]


def test_length_factor(spark):
    assert column(spark, T.length_factor, "x" * 120, "x" * 14, "Chapter one ........ 3") == [1.0, 0.4, 0.4]


def test_numerals(spark):
    assert column(spark, T.roman_numeral, "xiv", "MCMXC", "no") == [14, 1990, None]
    assert column(spark, T.chinese_numeral, "十二", "一百零三", "二十", "甲") == [12, 103, 20, None]


def test_strong_hits(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.7), (1, 3, 0.5), (1, 4, 0.2), (2, 1, 0.4), (3, 1, 0.0)], "query_id int, page int, score double")
    kept = {(r["query_id"], r["page"]) for r in search.strong(rows, ["query_id"]).collect()}
    assert kept == {(1, 1), (1, 2), (2, 1), (3, 1)}


def test_chunks_overlap_and_cuts():
    assert chunker.chunks("short") == ["short"] and chunker.chunks("") == []
    same = chunker.chunks("字" * 1600)
    assert all(len(c) <= 800 for c in same) and same[0][-96:] == same[1][:96]
    assert chunker.chunks("甲" * 520 + "\n\n" + "乙" * 420)[0] == "甲" * 520
    assert chunker.chunks("甲" * 540 + "。" + "乙" * 360)[0] == "甲" * 540 + "。"


def test_sections(spark):
    rows = [("c1", 0, 1, 10), ("c1-1", 1, 2, 10), ("c1-2", 2, 2, 15), ("c2", 3, 1, 20), ("c2-1", 4, 2, 20), ("c2-2", 5, 2, 28), ("c3", 6, 1, 35), ("app", 7, 1, None)]
    nodes = spark.createDataFrame([("b", o, d, n, p) for n, o, d, p in rows], "book_id string, ord long, depth int, label string, page long")
    found = {r["ord"]: (r["start"], r["end"]) for r in outline.section_ranges(nodes, spark.createDataFrame([("b", 100)], "book_id string, total long")).collect()}
    assert found == {0: (10, 19), 1: (10, 14), 2: (15, 19), 3: (20, 34), 4: (20, 27), 5: (28, 34), 6: (35, 100)}


def test_offset_votes(spark):
    cases = {"peak": [("anchor", 17)] + [("body", 17)] * 20 + [("body", 217)] * 4, "toc": [("toc", 0)] * 3 + [("anchor", 9), ("body", 9)], "only": [("toc", 0)] * 3, "one": [("anchor", 8)] + [("body", 10)] * 5, "two": [("anchor", 8)] * 2 + [("body", 10)] * 5}
    votes = spark.createDataFrame([(b, k, o) for b, v in cases.items() for k, o in v], "book_id string, kind string, offset long")
    assert {r["book_id"]: r["page_offset"] for r in outline.page_offset(votes).collect()} == {"peak": 17, "toc": 9, "only": 0, "one": 10, "two": 8}


def test_level_tree(spark):
    rows = spark.createDataFrame([("b", i, "x", level) for i, level in enumerate([1, 2, 3, 2, 1, 3])], "book_id string, ord long, label string, level int")
    assert [(r["parent"], r["depth"]) for r in outline.level_tree(rows).orderBy("ord").collect()] == [(None, 1), (0, 2), (1, 3), (0, 2), (None, 1), (4, 2)]


def test_upsert_and_transitions(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 2, 1), ("c", 3, 0)], "k string, v int, at int")
    assert sorted((r["k"], r["v"]) for r in state.upserted(old, new, ["k"], "at").collect()) == [("a", 2), ("b", 1), ("c", 3)]


def test_traces_skip_what_is_broken(spark):
    lines = spark.createDataFrame([(json.dumps({"ts": "2024-01-01T00:00:00+08:00", "kind": "view", "data": "{}"}),), ("{broken",), (json.dumps({"ts": "2024-01-01T00:00:00Z", "kind": "odd"}),)], "value string")
    assert [r["kind"] for r in traces(lines, ["view"]).collect()] == ["view"]


def run_stream(spark, tmp_path, batches, schema, fn, mode):
    source, out = tmp_path / "in", []
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"batch={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    query = fn(stream).writeStream.outputMode(mode).foreachBatch(lambda df, i: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    return out


def test_frontier_stream(spark, tmp_path):
    out = run_stream(spark, tmp_path, [[("b", p)] for p in (3, 2, 1, 5, 4)], "book_id string, page long", events.frontiers, "update")
    seen = [r[1] for batch in out for r in batch]
    assert max(seen) == 5 and len(seen) == 5 and seen == sorted(seen)


def test_repeat_stream(spark, tmp_path):
    rows = [[("r", i, "t", "a", "x", 600)] for i in range(4)]
    schema = "run_id string, seq long, tool string, args_hash string, result_hash string, chars int"
    out = run_stream(spark, tmp_path, rows, schema, events.repeats, "append")
    assert sorted(v for batch in out for *_, v in batch) == sorted(["full", "stub", "warn", "final"])
    # A chain goes by results, whatever was asked; tools and short results are told apart.
    cases = {"mixed": "ax bx bx ax", "args": "ax bx cx", "short": "ax bx cx ax", "tools": "ax ax"}
    rows = [(run, i, f"t{i}" if run == "tools" else "t", c[0], c[1], 100 if run == "short" else 600) for run, steps in cases.items() for i, c in enumerate(steps.split())]
    found = {}
    for r in events.repeat_verdicts(spark.createDataFrame(rows, schema)).orderBy("run_id", "seq").collect():
        found.setdefault(r["run_id"], []).append(r["verdict"])
    assert found == {"mixed": ["full", "stub", "warn", "final"], "args": ["full", "stub", "final"], "short": ["full", "full", "full", "final"], "tools": ["full", "full"]}


def test_sinks_and_caches_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "book_id string, page long, text string, ts timestamp, key string"
    for i, rows in enumerate([[("b", 1, "old", 0), ("b", 2, "two", 1)], [("b", 1, "new", 2), ("b", 0, "no", 3), ("c", 1, None, 4)]]):
        spark.createDataFrame([(*r[:3], None, f"k{r[3] % 2}") for r in rows], schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(source / f"batch={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    for query in (events.ingested(stream, str(tmp_path / "pages"), str(tmp_path / "c1")), events.trace_sink(stream.selectExpr("book_id", "ts", "text AS kind", "text AS data"), str(tmp_path / "traces"), str(tmp_path / "c2"))):
        query.processAllAvailable()
        query.stop()
    pages = {(r["book_id"], r["page"]): r["text"] for r in events.latest_pages(spark, str(tmp_path / "pages")).collect()}
    assert pages == {("b", 1): "new", ("b", 2): "two"}
    lines = spark.read.text(str(tmp_path / "traces"))
    assert lines.count() == 5 and traces(lines.where("book_id = 'b'")).count() == 4
    out = tmp_path / "once"
    query = events.results_once(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c3")).start(str(out))
    query.processAllAvailable()
    query.stop()
    assert spark.read.schema(schema).parquet(str(out)).count() == 2
