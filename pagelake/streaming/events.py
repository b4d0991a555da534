"""Event streams: each function takes a streaming or a batch DataFrame and returns one of the same kind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"
PREFIX_STATE = "frontier long, starts array<long>, ends array<long>"


def kind_counts(events: DataFrame) -> DataFrame:
    """(kind, n), in complete or update mode."""
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def last_values(events: DataFrame, width: str = "500 milliseconds", late: str = LATE) -> DataFrame:
    """(key, window_start, value): the last value of each key in each window; a throttled writer's output."""
    seen = events.withWatermark("ts", late).groupBy("key", F.window("ts", width)).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return seen.select("key", F.col("window.start").alias("window_start"), "value")


def idle_sessions(events: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """(key, session_start, session_end, n): runs of events of a key that no gap parts; what an idle timer ends."""
    seen = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return seen.select("key", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def merged_runs(starts: np.ndarray, ends: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (first, last) of numbers, apart and ascending, with more numbers put in."""
    first, last = np.concatenate((starts, pages)), np.concatenate((ends, pages))
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > reach[:-1] + 1
    at = np.flatnonzero(new)
    return first[at], reach[np.append(at[1:] - 1, len(first) - 1)] if len(first) else reach


def frontiers(completions: DataFrame, base: int = 1) -> DataFrame:
    """(book_id, frontier) after each trigger: the longest completed prefix from `base`, of pages that finish in any order.

    completions: streaming (book_id, page). State is the frontier and the runs of pages that finished ahead of it, so it is
    as large as there are gaps, whatever finished. Null pages and those below `base` count for nothing.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frontier, starts, ends = state.get if state.exists else (base - 1, [], [])
        for batch in batches:
            pages = np.unique(batch["page"].dropna().to_numpy(np.int64))
            starts, ends = merged_runs(np.array(starts, np.int64), np.array(ends, np.int64), pages[pages > frontier])
            if len(starts) and starts[0] <= frontier + 1:
                frontier, starts, ends = int(ends[0]), starts[1:], ends[1:]
        state.update((int(frontier), [int(x) for x in starts], [int(x) for x in ends]))
        yield pd.DataFrame({"book_id": [key[0]], "frontier": [frontier]})

    return completions.groupBy("book_id").applyInPandasWithState(advance, "book_id string, frontier long", PREFIX_STATE, "update", GroupStateTimeout.NoTimeout)


#: Results that are told apart in a run, and characters from which an equal one is left out.
WINDOW, STUB_CHARS = 8, 512


def verdicts(seen: list[tuple[str, str, str]], tool: str, args: str, result: str, chars: int) -> str:
    """What becomes of a tool's result, given the (tool, args, result) before it: full, stub, warn or final.

    Equal results of the tool make a chain, whatever was asked. Where one of them was asked alike, the fourth of the
    chain ends the run, the third warns and the second is left out if long. Else, if long, the third ends the run and
    the second is left out.
    """
    chain = [s for s in seen if s[0] == tool and s[2] == result]
    place, long = len(chain) + 1, chars >= STUB_CHARS
    if not chain:
        return "full"
    if any(s[1] == args for s in chain):
        return "final" if place >= 4 else "warn" if place == 3 else "stub" if long else "full"
    return "full" if not long else "final" if place >= 3 else "stub"


def repeats(results: DataFrame) -> DataFrame:
    """(run_id, seq, verdict) of streaming (run_id, seq, tool, args_hash, result_hash, chars). Each run keeps its last WINDOW fingerprints."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = [tuple(x.split("|", 2)) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for tool, args, result, chars in zip(rows["tool"], rows["args_hash"], rows["result_hash"], rows["chars"]):
            out.append(verdicts(seen, tool, args, result, chars))
            seen = [*seen, (tool, args, result)][-WINDOW:]
        state.update((["|".join(s) for s in seen],))
        yield pd.DataFrame({"run_id": key[0], "seq": rows["seq"].to_numpy(), "verdict": out})

    return results.groupBy("run_id").applyInPandasWithState(judge, "run_id string, seq long, verdict string", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def repeat_verdicts(results: DataFrame) -> DataFrame:
    """The same of a table of results, by windows over the last WINDOW rows of a run."""
    before = Window.partitionBy("run_id").orderBy("seq").rowsBetween(-WINDOW, -1)
    rows = results.withColumn("_seen", F.collect_list(F.struct("tool", "args_hash", "result_hash")).over(before))
    rows = rows.withColumn("_chain", F.filter("_seen", lambda s: (s["tool"] == F.col("tool")) & (s["result_hash"] == F.col("result_hash"))))
    place, long = F.size("_chain") + 1, F.col("chars") >= STUB_CHARS
    alike = F.exists("_chain", lambda s: s["args_hash"] == F.col("args_hash"))
    asked_alike = F.when(place >= 4, "final").when(place == 3, "warn").when(long, "stub").otherwise("full")
    others = F.when(~long, "full").when(place >= 3, "final").otherwise("stub")
    return rows.select("run_id", "seq", F.when(F.size("_chain") == 0, "full").when(alike, asked_alike).otherwise(others).alias("verdict"))


def results_once(results: DataFrame, kept: str = "15 minutes") -> DataFrame:
    """Streaming (key, ts, …): one row a key within `kept`, as a cache of answers would give."""
    return results.withWatermark("ts", kept).dropDuplicatesWithinWatermark(["key"])


def trace_lines(traces: DataFrame) -> DataFrame:
    """(book_id, value): traces (book_id, ts, kind, data) as JSON lines."""
    return traces.select("book_id", F.to_json(F.struct("ts", "kind", "data")).alias("value"))


def trace_sink(traces: DataFrame, path: str, checkpoint: str):
    """A stream of traces appended as JSON lines, in a folder for each book."""
    return trace_lines(traces).writeStream.format("text").partitionBy("book_id").option("checkpointLocation", checkpoint).start(path)


def ingested(pages: DataFrame, path: str, checkpoint: str):
    """Recognised pages (book_id, page, text) as they come: each micro-batch is one file set named by its number.

    Written again when it is tried again, so a page counts once; `latest_pages` reads the last of each.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.where("page >= 1 AND text IS NOT NULL").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def latest_pages(spark, path: str) -> DataFrame:
    """(book_id, page, text): of what `ingested` wrote the last text of each page."""
    rows = spark.read.schema("book_id string, page long, text string, batch long").option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy("book_id", "page").agg(F.max_by("text", F.struct("batch", "text")).alias("text"))
