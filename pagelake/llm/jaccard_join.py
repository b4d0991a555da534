"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at least 75 %.

1. Exact copies are one class by digest; only its smallest document goes on.
2. Document frequencies of all shingles are counted (packed sorted hashes, exchanged by hash range). The most frequent
   ones, at most HOT of them, are ordered last, by frequency; the others by hash. Any order gives the same links.
3. A set of n shingles needs o = ceil(0.75 n) of them in any partner. Its prefix of length n - o + l shares l shingles
   or more with the prefix of every partner (the larger l of the two taken down to the smaller). Documents begin with
   l = 1; the estimated cost of a prefix is the sum of its frequencies, and l grows with its excess over one a shingle.
4. Components need connections, not all pairs. A document of each shingle is its pivot, and each document is verified
   against the pivot it shares most with (`rounds` draws further pivots while many pairs of different components are
   left; one round is what the query uses). Then every pair that is left, in different components and sharing as many
   prefix shingles as its smaller l, is verified. So no link between different components is lost.
5. Verification intersects the whole sets, by hashes of 64 bits; it streams the documents of a pivot past the pivot's set.

A very long text is one set, some 30 bytes of memory a word. Ties between pivots go to the smaller doc_id. Null or empty texts have an empty set and link with nothing, not with each other. Repeated rows are exact copies; a
repeated doc_id with different texts is not told apart, so ids should be unique. Rows without doc_id take no part: they
have no row in `near_duplicates`, and `one_of_each` keeps them. An empty table gives no rows. Extra columns are not read
by `near_duplicates` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U, shingle_sets
from .common import BROADCAST_IDS, components, small_batches, without, written

PERCENT, WORDS = 75, 5
#: Shingles whose frequency is told to every task (16 bytes each), and the least such frequency.
HOT, HOT_DF = 500_000, 16
#: The longest a prefix is lengthened by, in shingles and matches.
MOST_MATCHES = 4
#: Documents that one pivot's partition verifies; more are salted.
ROWS_A_PIVOT = 1_000
#: Rounds of pivots end when so few pairs of different components are left to look at, or a round finds hardly a link.
PAIRS_A_DOCUMENT = 1
#: Bytes of text whose shingles make up one hash range, which one task sorts at a time.
RANGE_BYTES = 16 << 20
#: Hashes are 64 bits where sets are intersected, 48 in the rows of prefixes (equal ones there only lead to a pair that is
#: verified), and 40 where they are counted (which decides the order of shingles, not links).
ROW_SHIFT, SHIFT = U(16), U(24)
#: Copies of one text beyond which its class is told to every task: at least so many, and a ten thousandth of all rows.
BIG_CLASS = 1_000


def _packed(short: np.ndarray) -> bytes:
    """Five bytes each of hashes of 40 bits."""
    return np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return wide.view(U).ravel()


def _needed(n: np.ndarray | int):
    """The least overlap that a set of n shingles can have with a partner."""
    return -(-n * PERCENT // 100)


def _ranges(ranges: int):
    """For mapInArrow over (text): sorted distinct hashes of the texts' shingles by hash range, in how many of the texts each is.

    Those of one text are apart from the others, as they need no number. Work goes with the hashes, not the ranges.
    """
    width = U(-(-(1 << 40) // ranges))

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held) >> SHIFT, return_counts=True)
        rows = []
        for keep, told in ((counts == 1, False), (counts > 1, True)):
            some, n = tokens[keep], counts[keep].astype(np.int32)
            at = some // width
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(some) else np.zeros(0, np.int64)
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(some)]):
                rows.append((int(at[i]), _packed(some[i:j]), n[i:j].tobytes() if told else None))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["range", "tokens", "counts"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for tokens in shingle_sets(batch.column("text"), WORDS):
                held.append(tokens)
                size += len(tokens)
                if size > 1_000_000:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return made


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of partitions of whole ranges: hashes of HOT_DF documents or more, with their number. One range is held at a time."""
    def told(parts: list[tuple[bytes, bytes | None]]) -> pa.RecordBatch:
        tokens = [_unpacked(x) for x, _ in parts]
        n = np.concatenate([np.ones(len(t), np.int64) if c is None else np.frombuffer(c, np.int32) for t, (_, c) in zip(tokens, parts)])
        tokens, at = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(at, n).astype(np.int64)
        keep = df >= HOT_DF
        return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(df[keep])], ["token", "df"])

    now, parts = None, []
    for batch in batches:
        for key, blob, counts in zip(batch.column("range").to_pylist(), batch.column("tokens"), batch.column("counts")):
            if key != now and parts:
                yield told(parts)
                parts = []
            now = key
            parts.append((blob.as_py(), counts.as_py()))
    if parts:
        yield told(parts)


def frequencies(docs: DataFrame, text_bytes: int) -> DataFrame:
    """(token, df): the at most HOT most frequent shingles of `docs`, which have so many bytes of text."""
    ranges = docs.select("text").mapInArrow(_ranges(max(12, text_bytes // RANGE_BYTES)), "range long, tokens binary, counts binary")
    counted = ranges.repartition("range").sortWithinPartitions("range").mapInArrow(_frequent, "token long, df long")
    return counted.orderBy(F.col("df").desc(), "token").limit(HOT)


def _prefixes(hot):
    """For mapInArrow over (doc_id, text): a row for each shingle of each document's adaptive prefix, and one with its size and l."""
    def of_document(doc: int, tokens: np.ndarray, known: np.ndarray, df_of: np.ndarray) -> tuple:
        n = len(tokens)
        df = np.ones(n, dtype=np.int64)
        if len(known) and n:
            short = tokens >> SHIFT
            at = np.minimum(np.searchsorted(known, short), len(known) - 1)
            df = np.where(known[at] == short, df_of[at], 1)
        order = np.lexsort((tokens, df))
        shortest = n - _needed(n) + 1 if n else 0
        cost = float(df[order[:shortest]].sum()) / max(shortest, 1)
        matches = int(min(1 + math.log2(max(cost, 1.0)) // 2, MOST_MATCHES, 1 + shortest // 8))
        taken = (tokens[order[: shortest + matches - 1]] >> ROW_SHIFT).view(np.int64) if n else np.zeros(0, np.int64)
        none = np.full(len(taken), -1)
        # The row with the sizes has a token of its own, so that it is dealt out like any other.
        own = -doc - 1 if doc >= 0 else doc
        return np.full(len(taken) + 1, doc), np.append(taken, own), np.arange(len(taken) + 1), np.append(none, n), np.append(none, matches)

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        doc, token, at, n, matches = (np.concatenate(x) for x in zip(*parts))
        plain = n < 0
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(token.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32), mask=plain), pa.array(matches.astype(np.int32), mask=plain)], COLUMNS)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df_of = hot.value
        for batch in batches:
            parts: list[tuple] = []
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), WORDS)):
                parts.append(of_document(doc, tokens, known, df_of))
                if len(parts) >= 500:
                    yield rows(parts)
                    parts = []
            if parts:
                yield rows(parts)

    return made


COLUMNS = ["doc_id", "token", "at", "n", "matches"]
PREFIX = "doc_id long, token long, at int, n int, matches int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and doc_id: those whose token has another row, each with the first document as `pivot`.

    Rows with sizes pass as they are, with a null pivot.
    """

    def out(rows: pa.RecordBatch, pivot: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        pivots = pa.array(pivot.astype(np.int64), mask=~more)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in COLUMNS), pivots], [*COLUMNS, "pivot"]).filter(pa.array(more | rows.column("n").is_valid().to_numpy(zero_copy_only=False)))

    last, last_token, pivot, had = None, None, 0, False
    for batch in batches:
        token, doc = batch.column("token").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(token):
            continue
        new = np.concatenate(([token[0] != last_token], token[1:] != token[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
        first = np.where(start < 0, pivot, doc[np.maximum(start, 0)])
        more = np.concatenate((~new[1:], [False])) | ~new  # a later row of the token in this batch, or an earlier one
        if last is not None:  # the batch before ended in a row whose token may go on here
            yield out(last, np.array([pivot]), np.array([had or not new[0]]))
        yield out(batch.slice(0, len(token) - 1), first[:-1], more[:-1])
        last, last_token, pivot, had = batch.slice(len(token) - 1), token[-1], first[-1], bool(more[-1])
    if last is not None:
        yield out(last, np.array([pivot]), np.array([had]))


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = pa.array([x.tobytes() for x in shingle_sets(batch.column("text"), WORDS)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("salt"), batch.column("doc_id"), blobs], ["pivot", "salt", "doc_id", "tokens"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by pivot, salt and whether they are the pivot itself: the links (a, b)."""
    key, own = None, None
    for batch in batches:
        a, b = [], []
        for pivot, salt, doc, blob in zip(batch.column("pivot").to_pylist(), batch.column("salt").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tokens")):
            tokens = np.frombuffer(blob.as_py(), U)
            if pivot == doc:
                key, own = (pivot, salt), tokens
            elif key == (pivot, salt):
                same = len(np.intersect1d(own, tokens, assume_unique=True))
                if 100 * same >= PERCENT * (len(own) + len(tokens) - same) and same:
                    a.append(doc)
                    b.append(pivot)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (doc_id, pivot) of distinct documents that link, as (a, b)."""
    pairs = written(pairs)
    many = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(ROWS_A_PIVOT)).cast("int").alias("salts"))
    if (n := pairs.count()) <= BROADCAST_IDS:
        many = F.broadcast(many)
    salted = pairs.join(many, "pivot").select("pivot", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.col("doc_id").alias("d"))
    own = many.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("d"))
    wanted = salted.union(own)
    wanted = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("d")).select("pivot", "salt", "doc_id", "text")
    blobs = texts.mapInArrow(_blobs, "pivot long, salt int, doc_id long, tokens binary")
    streams = blobs.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("pivot") != F.col("doc_id"))
    return written(streams.mapInArrow(_verified, "a long, b long"))


def _classes(members: DataFrame, n_rows: int) -> DataFrame:
    """(doc_id, rep) of (doc_id, digest): the smallest doc_id with the same digest.

    Large classes are told to every task, at most 10,000 of them, as a class would else be one task's rows.
    """
    classes = written(members.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    big = F.col("n") > max(BIG_CLASS, n_rows // 10_000)
    large = F.broadcast(classes.where(big).select(F.col("digest").alias("large"), F.col("rep").alias("large_rep")))
    placed = members.select("doc_id", "digest").join(large, F.col("digest") == F.col("large"), "left")
    # Rows of large classes have a key of their own where the others are joined.
    key = F.when(F.col("large").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string")))
    others = classes.where(~big).select(F.col("digest").alias("other"), "rep")
    return placed.withColumn("key", key).join(others, F.col("key") == F.col("other"), "left").select("doc_id", F.coalesce("large_rep", "rep", "doc_id").alias("rep"))


def near_duplicates(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.where("doc_id IS NOT NULL")
    members = written(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.octet_length("text").alias("bytes")))
    text_bytes, n_rows = members.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    members = written(_classes(members, n_rows))
    unique = members.where("doc_id = rep").select(F.col("rep").alias("r")).distinct()
    copies = written(members.where("doc_id <> rep").select(F.col("doc_id").alias("r")).distinct())
    own = docs.select("doc_id", "text")
    reps = own.join(F.broadcast(copies), F.col("doc_id") == F.col("r"), "left_anti") if copies.count() <= BROADCAST_IDS else own.join(unique, F.col("doc_id") == F.col("r"), "left_semi")

    top = frequencies(reps, text_bytes).toPandas()  # at most HOT rows
    top = top.sort_values("token", key=lambda s: s.to_numpy().view(U))
    hot = spark.sparkContext.broadcast((top["token"].to_numpy().view(U), top["df"].to_numpy()))
    rows = reps.mapInArrow(_prefixes(hot), PREFIX)
    shared = written(rows.repartition("token").sortWithinPartitions("token", "doc_id").mapInArrow(_shared, PREFIX + ", pivot long"))
    sizes = written(shared.where("n IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n"), F.max("matches").alias("matches")))
    active = shared.where("n IS NULL").select("doc_id", "token", "at", "pivot")
    size_of = lambda side: sizes.select(F.col("doc_id").alias(f"_{side}"), F.col("n").alias(f"n_{side}"), F.col("matches").alias(f"matches_{side}"))

    def able(pairs: DataFrame) -> DataFrame:
        """Pairs (doc_id, pivot, c) that may link: of like sizes, with c shared prefix shingles as the smaller l asks for,
        and enough with all that stands behind the prefix of the one whose prefix ends first in the order (either may)."""
        both = pairs.join(size_of("x"), F.col("doc_id") == F.col("_x")).join(size_of("y"), F.col("pivot") == F.col("_y"))
        behind = " , ".join(f"ceil({PERCENT} * n_{side} / 100) - matches_{side}" for side in "xy")
        sizes = f"100 * least(n_x, n_y) >= {PERCENT} * greatest(n_x, n_y) AND c >= least(matches_x, matches_y)"
        return both.where(f"{sizes} AND c + greatest({behind}) >= ceil({PERCENT} * (n_x + n_y) / {100 + PERCENT})")

    # First the pivots as they are, then others, drawn anew each round.
    stars = active.where("doc_id <> pivot")
    links = None
    for turn in range(rounds):
        tried = able(stars.groupBy("doc_id", "pivot").agg(F.count("*").alias("c")))
        best = tried.groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("m"))
        new = verified(reps, best.select("doc_id", (-F.col("m.p")).alias("pivot")))
        links = new if links is None else links.union(new)
        named = components(links, spark).withColumnRenamed("node", "d")
        placed = active.join(named, F.col("doc_id") == F.col("d"), "left").join(size_of("s"), F.col("doc_id") == F.col("_s"))
        # Two documents of n and m shingles need (n + m) 3 / 7 in common, so their first l common ones stand early in at
        # least one of them: at 1 / 7 of it or before, but for l.
        early = F.expr(f"at <= n_s - ceil({2 * PERCENT} * n_s / {100 + PERCENT}) + matches_s")
        placed = placed.select("doc_id", "token", "at", F.col("n_s").alias("n"), F.col("matches_s").alias("matches"), F.coalesce("component", "doc_id").alias("label"), early.alias("early"))
        per = placed.groupBy("token", "label").agg(F.count("*").alias("k"), F.count_if("early").alias("e")).groupBy("token").agg((F.sum("k") * F.sum("e") - F.sum(F.col("k") * F.col("e"))).alias("pairs"))
        open_rows = written(placed.join(per.where("pairs > 0").select(F.col("token").alias("t"), "pairs"), F.col("token") == F.col("t")).select(*placed.columns, "pairs"))
        count, found = open_rows.select("token", "pairs").distinct().agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0], new.count()
        if count <= PAIRS_A_DOCUMENT * sizes.count() or found < 100:
            break
        drawn = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "label")
        pivots = open_rows.groupBy(F.col("token").alias("t")).agg(F.min(drawn).alias("one"))
        stars = open_rows.join(pivots, F.col("token") == F.col("t")).where("label <> one.label").select("doc_id", F.col("one.doc_id").alias("pivot"))
    left, right = open_rows.where("early").alias("x"), open_rows.alias("y")
    reach = lambda side: f"{side}.at <= {side}.n - ceil({PERCENT} * (x.n + y.n) / {100 + PERCENT}) + least(x.matches, y.matches) - 1"
    meet = f"x.label <> y.label AND (NOT y.early OR x.doc_id < y.doc_id) AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) AND {reach('x')} AND {reach('y')}"
    met = left.join(right, (F.col("x.token") == F.col("y.token")) & F.expr(meet)).groupBy(F.greatest("x.doc_id", "y.doc_id").alias("doc_id"), F.least("x.doc_id", "y.doc_id").alias("pivot"), F.least("x.matches", "y.matches").alias("least")).agg(F.count("*").alias("c"))
    links = links.union(verified(reps, met.where("c >= least").select("doc_id", "pivot")))
    labels = components(links, spark)

    per_rep = sizes.join(labels, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("r"), F.col("n").alias("n"), F.coalesce("component", "doc_id").alias("c"))
    out = members.join(per_rep, F.col("rep") == F.col("r"), "left")
    # Texts without words are copies of each other, or not, but link with nothing.
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.coalesce("n", F.lit(0)) > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document, the smallest doc_id, of each group of near duplicates; all columns as they are."""
    gone = near_duplicates(docs).where("doc_id <> component_id")
    return without(docs, gone.select(F.col("doc_id").alias("gone_id")).distinct())


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
