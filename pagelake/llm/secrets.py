"""Secret scans with corpus-wide ownership frequency.

Base spans are the matches of three patterns. The method looks at what the patterns miss as well: long mixed runs of
letters and digits. Every candidate's hash is counted over the whole corpus by distinct repositories and owners; a run
that fewer than `example_owners` owners have looks live and is added as a span of kind `live`, one that more have is an
example that people copy. Base spans stay whatever the counts say; the counts are reported with them.

Repository: the column `source`; owner: what stands before its first "/", or all of it. A null source counts as one
repository of its own. Null or empty texts, and rows without doc_id, have no spans. Repeated rows give equal rows; rows
that share a doc_id alone have the spans of their own texts. Spans that tie for a start are listed by kind. A very long
text's matches are placed in runs of RUN_MATCHES, so the work grows with their number. An empty table gives no rows.
Extra columns are kept by `redacted`, whatever their names, and not read by `scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_before, rows_of, written


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either_case('api')}_?{_either_case('key')}"
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Long enough matches of ACCESS and HEX only; the same spans, as both take whole runs.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")
#: Matches of a text that are placed, or compared with others, at a time: SQL's arrays are copied as they grow.
RUN_MATCHES = 256


def _chunked(array: str) -> str:
    """SQL for an array in runs of RUN_MATCHES."""
    return f"transform(if(size({array}) > 0, sequence(0, (size({array}) - 1) div {RUN_MATCHES}), array()), c -> slice({array}, c * {RUN_MATCHES} + 1, {RUN_MATCHES}))"


_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'") + "'"


def _spans(text: str, pattern: str, kind: int, value_group: int = 0, least: int = 1, if_has: str | None = None) -> str:
    """SQL for the leftmost non-overlapping matches: array<struct<start, kind, end, value>>, in code points.

    Matches and what lies between them come from the same pattern, so running sums of their lengths are the offsets:
    within runs of matches, then of the runs.
    """
    p, none = _literal(pattern), f"cast(array() AS {_SPANS})"
    hits = f"regexp_extract_all({text}, {p}, 0)"
    matches = f"arrays_zip(split({text}, {p}, -1), {hits}, {f'regexp_extract_all({text}, {p}, {value_group})' if value_group else hits})"
    named = f"transform({matches}, m -> named_struct('gap', m.`0`, 'hit', m.`1`, 'value', m.`2`))"
    end = "a.at + length(m.gap) + length(m.hit)"
    span = f"named_struct('start', a.at + length(m.gap), 'kind', {kind}, 'end', {end}, 'value', m.value)"
    step = f"named_struct('at', {end}, 'spans', if(length(m.value) >= {least}, concat(a.spans, array({span})), a.spans))"
    placed = f"transform({_chunked('z')}, r -> aggregate(filter(r, m -> m.hit IS NOT NULL), named_struct('at', 0, 'spans', {none}), (a, m) -> {step}))"
    starts = "aggregate(y, named_struct('at', 0, 's', cast(array() AS array<int>)), (a, r) -> named_struct('at', a.at + r.at, 's', concat(a.s, array(a.at))), a -> a.s)"
    shifted = "transform(r.spans, x -> named_struct('start', x.start + s, 'kind', x.kind, 'end', x.end + s, 'value', x.value))"
    found = f"flatten(flatten(transform(array({named}), z -> transform(array({placed}), y -> flatten(zip_with(y, {starts}, (r, s) -> {shifted}))))))"
    return f"if({text} rlike {_literal(if_has or pattern)}, {found}, {none})"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, repository, owner, base, runs): base spans sorted by start and kind; runs are what no base span overlaps."""
    rows = docs.select("doc_id", F.expr("coalesce(text, '')").alias("t"), F.coalesce("source", F.lit("")).alias("repository"))
    base = f"array_sort(concat({_spans('t', ASSIGN, 0, 2, 6, _KEYS)}, {_spans('t', LONG_ACCESS, 1)}, {_spans('t', LONG_HEX, 2)}))"
    found = rows.select("doc_id", F.md5("t").alias("text_hash"), "repository", F.expr(base).alias("base"), F.expr(_spans("t", RUN, 3)).alias("runs"))
    # Base spans by runs of them, each with where it begins and ends, so that a candidate looks into few.
    blocks = f"transform({_chunked('base')}, c -> struct(c AS c, c[0].start AS lo, array_max(transform(c, b -> b.end)) AS hi))"
    free = "NOT exists(z, k -> k.lo < r.end AND r.start < k.hi AND exists(k.c, b -> b.start < r.end AND r.start < b.end))"
    mixed = f"r -> r.value rlike '[A-Za-z]' AND r.value rlike '[0-9][^0-9]*[0-9]' AND {free}"
    hashed = "transform({0}, s -> struct(s.start AS start, s.kind AS kind, s.end AS end, sha2(s.value, 224) AS value))"
    # The blocks are bound by a transform over an array of one: in a column, Spark would make them anew for each run.
    return found.withColumn("runs", F.expr(f"transform(array({blocks}), z -> filter(runs, {mixed}))[0]")).select(
        "doc_id", "text_hash", "repository", F.substring_index("repository", "/", 1).alias("owner"), F.expr(hashed.format("base")).alias("base"), F.expr(hashed.format("runs")).alias("runs"))


def scan(docs: DataFrame, example_owners: int = 3) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, base, spans (array<struct<start, kind, end, repositories, owners>>), n_live, n_example."""
    found = written(candidates(docs.withColumn("text", F.when(F.col("doc_id").isNotNull(), F.col("text")))))
    each = found.select("doc_id", "text_hash", "repository", "owner", F.explode(F.concat("base", "runs")).alias("s"))
    # Distinct first, so that a secret in a million documents leaves each task once.
    seen = each.select(F.col("s.value").alias("value"), "repository", "owner").distinct()
    counts = seen.groupBy("value").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    # A value of very many documents makes a large partition of small rows, which adaptive execution splits.
    flagged = each.join(counts, F.col("s.value") == F.col("value")).where(f"s.kind < 3 OR owners < {example_owners}")
    spans = flagged.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.array_sort(F.collect_set(F.struct("s.start", "s.kind", "s.end", "repositories", "owners"))).alias("_spans"))
    none = F.expr("cast(array() AS array<struct<start: int, kind: int, end: int, repositories: bigint, owners: bigint>>)")
    out = found.join(spans, (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left").withColumn("spans", F.coalesce("_spans", none))
    return out.select("doc_id", "text_hash", "base", "spans",
        F.expr(f"size(filter(spans, s -> s.owners < {example_owners}))").cast("long").alias("n_live"), F.expr(f"size(filter(spans, s -> s.owners >= {example_owners}))").cast("long").alias("n_example"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", example_owners: int = 3) -> DataFrame:
    """`docs` with every base span and every live one replaced in `text`; overlapping spans are one. Other columns stay."""
    spans = scan(docs, example_owners).where("size(spans) > 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("spans").alias("_s")).dropDuplicates(["_d", "_h"])
    none = "cast(array() AS array<struct<start: int, end: int>>)"
    joined = """if(size(a) > 0 AND s.start < element_at(a, -1).end,
      concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(s.end, element_at(a, -1).end) AS end))), concat(a, array(s)))"""
    # Runs of spans are joined each, then where one run ends and the next begins: a run's first span may go on the last's.
    within = f"transform({_chunked('_s')}, c -> aggregate(c, {none}, (a, t) -> transform(array(struct(t.start AS start, t.end AS end)), s -> {joined})[0]))"
    reach = "aggregate(m, named_struct('hi', 0, 'out', cast(array() AS array<int>)), (a, c) -> named_struct('hi', greatest(a.hi, element_at(c, -1).end), 'out', concat(a.out, array(a.hi))), a -> a.out)"
    # What an earlier run covers is cut off a later run's spans; spans that this leaves adjoining stay one mark.
    cut = "filter(transform(c, s -> struct(greatest(s.start, hi) AS start, s.end AS end, s.start < hi AS more)), s -> s.start < s.end)"
    merged = f"filter(flatten(transform(array({within}), m -> zip_with(m, {reach}, (c, hi) -> {cut}))), c -> size(c) > 0)"
    # A run's part of the text is cut out first: to find a place in a string, SQL walks to it.
    before = "if(i = 0, 0, z.c[i - 1].end - z.at)"
    marked = f"array_join(transform(z.c, (s, i) -> concat(substring(y, {before} + 1, s.start - z.at - {before}), if(s.more, '', '{mark}'))), '')"
    part = f"transform(array(substring(text, z.at + 1, element_at(z.c, -1).end - z.at)), y -> {marked})[0]"
    pieces = f"""concat(transform(_m, (c, q) -> transform(array(named_struct('at', if(q = 0, 0, element_at(_m[q - 1], -1).end), 'c', c)), z -> {part})[0]),
      array(substring(text, element_at(element_at(_m, -1), -1).end + 1)))"""
    met = rows_of(docs).withColumn("text_hash", F.md5(F.coalesce("text", F.lit("")))).join(spans.withColumn("_m", F.expr(merged)), (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return as_before(met.withColumn("text", F.when(F.col("_d").isNull(), F.col("text")).otherwise(F.expr(f"array_join({pieces}, '')"))), docs)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_example")


def _sql() -> str:
    def raw(kind: int, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        return (f"SELECT doc_id, {kind} AS kind, unnest(regexp_extract_all(text, '{p}')) AS hit, unnest(regexp_extract_all(text, '{p}', {group})) AS value, "
                f"unnest(string_split_regex(text, '{p}')) AS gap, unnest(range(0, len(string_split_regex(text, '{p}')))) AS i FROM t WHERE regexp_matches(text, '{p}')")  # fmt: skip

    text = " UNION ALL ".join(raw(*x) for x in ((0, ASSIGN, 2), (1, LONG_ACCESS, 0), (2, LONG_HEX, 0), (3, RUN, 0)))
    name = "['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e"
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS repository, coalesce(text, '') AS text FROM documents),
raw AS ({text}),
placed AS (
  SELECT doc_id, kind, hit, value, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM raw WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
spans AS (SELECT doc_id, kind, value, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e FROM placed WHERE hit IS NOT NULL AND (kind > 0 OR length(value) >= 6)),
kept AS (
  SELECT * FROM spans x WHERE kind < 3 OR regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9][^0-9]*[0-9]')
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = x.doc_id AND b.kind < 3 AND b.s < x.e AND x.s < b.e)),
counts AS (SELECT value, count(DISTINCT split_part(repository, '/', 1)) AS owners FROM kept JOIN t USING (doc_id) GROUP BY value),
flagged AS (SELECT doc_id, kind, s, e, owners FROM kept JOIN counts USING (value) WHERE kind < 3 OR owners < 3)
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({name}, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg({name}, ',' ORDER BY s, kind), '') AS spans,
  count(*) FILTER (owners < 3) AS n_live, count(*) FILTER (owners >= 3) AS n_example
FROM t LEFT JOIN flagged USING (doc_id) GROUP BY t.doc_id
"""


OP8_SQL = _sql()
