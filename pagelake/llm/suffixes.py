"""Exact removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of LENGTH bytes covers it that also starts earlier (in a smaller doc_id, or earlier in the same
document). Sorting every suffix of a corpus moves many times its size, so only suffixes that can matter are sorted:

1. Anchors. In every LENGTH-byte string the least hash of its GRAM-byte grams, the leftmost on ties, marks a position;
   equal strings mark the same one. About one position in 35 is marked. An anchor's context is all that the strings
   around it hold: the bytes from LENGTH - GRAM before it to LENGTH after its start.
2. Anchors meet by the hash of their gram. One whose whole context occurs earlier is repeated throughout; that needs no
   sorting. Contexts are told apart by 96 bits beside the 64 of their gram, not byte by byte. Of each distinct context
   the first anchor is left, and only if its gram has other contexts. Of hot grams (`hot_grams`) contexts are dealt out
   one by one, and their strings meet by 128 bits of hashes instead of the merge, so that no gram is one task's work.
3. The suffixes at those anchors, LENGTH bytes each, are sorted in runs where their texts are read and exchanged
   front-coded: the length of the prefix shared with the suffix before, and the rest. A loser tree merges the runs; it
   knows each head's common prefix with the last suffix that left and compares only behind it, so the merged order
   comes with its common prefixes. Neighbours that share a gram form a group; in it a string around an anchor is
   looked up by what is left and right of the anchor, only as far as the common prefixes reach.
4. The spans found meet their documents, which are cut.

Texts are UTF-8 bytes; null is empty. Texts below LENGTH bytes and rows without doc_id lose nothing. Repeated document ids: each row is cut by
the spans of all rows of the id, so ids should be unique. A very long text is one array, some 100 bytes of memory a
byte. Ties between equal strings go to the smaller doc_id and start. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import _OF_BYTE, _P, U, mix, pieces, powers, texts_of
from .common import small_batches, written

LENGTH, GRAM = 100, 32
#: A second base of polynomial hashes.
_P2 = 0xD6E8FEB86659FD93
#: Grams with more than this share of the anchors of every 16th text are hot: at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.002
#: Groups of documents in which a hot gram's contexts meet first; the first of each group then meet one another.
SALTS = 64
LEFT = LENGTH - GRAM
WINDOW = LENGTH - GRAM + 1


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_OF_BYTE[data] * powers(_P, len(data)), dtype=U, out=sums[1:])
    return sums


def _hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * inverse[start]


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, position in it, hash of the gram, 64 and 32 bits of hashes of the context) of the anchors of a run of texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(U), none.view(U), none.astype(np.int32)
    sums, inverse = _prefix_sums(data), powers(pow(_P, -1, 1 << 64), n + 1)
    grams = n - GRAM + 1
    hashes = mix((sums[GRAM:] - sums[:grams]) * inverse[:grams])
    keys = (hashes & ~U(0xFFFFFFFF)) | np.arange(grams, dtype=U)
    # Minima of all windows: of a block's end and the next block's beginning.
    blocks = -(-grams // WINDOW) + 1
    padded = np.full(blocks * WINDOW, ~U(0), dtype=U)
    padded[:grams] = keys
    square = padded.reshape(blocks, WINDOW)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - LENGTH + 1], ahead[WINDOW - 1 : WINDOW - 1 + n - LENGTH + 1])
    # Strings must not reach into the next text.
    room = np.repeat(offsets[1:], np.diff(offsets))[: n - LENGTH + 1] - np.arange(n - LENGTH + 1) >= LENGTH
    at = np.unique(least[room] & U(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, at, side="right") - 1
    begin, end = np.maximum(at - LEFT, offsets[text]), np.minimum(at + LENGTH, offsets[text + 1])
    shape = mix((at - begin).astype(U) * U(1 << 20) + (end - at).astype(U))
    context = mix(_hash(sums, inverse, begin, end) + shape)
    # A second hash of its own powers, so that contexts are told apart by 96 bits, and by the 64 of their gram.
    other = np.zeros(n + 1, dtype=U)
    np.cumsum(_OF_BYTE[data] * powers(_P2, n), dtype=U, out=other[1:])
    more = mix(_hash(other, powers(pow(_P2, -1, 1 << 64), n + 1), begin, end) + shape)
    return text, at - offsets[text], hashes[at], context, (more >> U(32)).astype(np.uint32).view(np.int32)


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text): (gram, n) of grams that are many in a batch, and the number of its anchors as gram 0."""
    for batch in batches:
        found = [anchors_of(data, offsets)[2] for _, _, data, offsets in pieces(*texts_of(batch.column("text")))]
        gram, n = np.unique(np.concatenate(found) if found else np.zeros(0, U), return_counts=True)
        keep = n > HOT_SHARE / 2 * n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(gram[keep].view(np.int64), 0)), pa.array(np.append(n[keep], n.sum()).astype(np.int64))], ["gram", "n"])


def hot_grams(texts: DataFrame) -> np.ndarray:
    """Grams that would fill a task: found on a sixteenth of the texts, as they only decide how work is split, never a result."""
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).select("text").mapInArrow(_heavy, "gram long, n long")
    sums = some.groupBy("gram").agg(F.sum("n").alias("n"))
    total = sums.where("gram = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.array(sorted(r["gram"] for r in sums.where(f"gram <> 0 AND n > {max(1000, int(HOT_SHARE * total))}").collect()), dtype=np.int64)  # at most 1 / HOT_SHARE rows


def _anchors(hot: np.ndarray):
    """For mapInArrow over (doc_id, text): the anchors, and the part of the work they belong to: their gram's, of hot grams
    that of their context and one of SALTS groups of documents."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, past, data, offsets in pieces(*texts_of(batch.column("text"))):
                text, at, gram, context, more = anchors_of(data, offsets)
                gram, context = gram.view(np.int64), context.view(np.int64)
                salted = mix(context.view(U) ^ (ids[first:past][text] % SALTS).astype(U)).view(np.int64)
                part = np.where(np.isin(gram, hot), salted, gram)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(gram), pa.array(context), pa.array(more), pa.array(ids[first:past][text]), pa.array(at.astype(np.int32))], ["part", "gram", "context", "more", "doc_id", "at"])

    return made


def _met(hot: np.ndarray):
    """For mapInArrow over anchors sorted by gram, context, more, doc_id, at: those repeated throughout (first = false), and
    the first of each context whose gram has others, or is hot (first = true). The first anchor of a gram waits until another context comes."""

    def out(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        # Contexts are kept of hot grams' first anchors only, which meet once more.
        no = ~(first & np.isin(rows.column("gram").to_numpy(), hot))
        told = [pa.array(rows.column(c).to_numpy(), mask=no) for c in ("context", "more")]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("at"), rows.column("gram"), pa.array(first), *told], ["doc_id", "at", "gram", "first", "context", "more"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram0 = context0 = more0 = waiting = None
        for batch in batches:
            if not len(batch):
                continue
            gram, context, more = (batch.column(c).to_numpy() for c in ("gram", "context", "more"))
            new_gram = np.concatenate(([gram[0] != gram0], gram[1:] != gram[:-1]))
            new_context = new_gram | np.concatenate(([context[0] != context0 or more[0] != more0], (context[1:] != context[:-1]) | (more[1:] != more[:-1])))
            other = new_context & ~new_gram
            group = np.cumsum(new_gram)  # 0: goes on from the batch before
            has_other = np.zeros(group[-1] + 1, dtype=bool)
            has_other[group[other | np.isin(gram, hot)]] = True
            if waiting is not None and has_other[0]:
                yield out(waiting, np.array([True]))
                waiting = None
            first = other | (new_gram & has_other[group])
            keep = first | ~new_context
            if keep.any():
                yield out(batch.filter(pa.array(keep)), first[keep])
            if group[-1] > 0:
                last = int(np.flatnonzero(new_gram)[-1])
                waiting = None if has_other[-1] else batch.slice(last, 1)
            gram0, context0, more0 = gram[-1], context[-1], more[-1]

    return made


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, ats): 128 bits of hashes of every LENGTH-byte string around the anchors, with its start."""
    for batch in batches:
        ids, ats = batch.column("doc_id").to_numpy(), batch.column("ats").to_pylist()
        for first, past, data, offsets in pieces(*texts_of(batch.column("text"))):
            at = [np.asarray(a, np.int64) for a in ats[first:past]]
            text = np.repeat(np.arange(past - first), [len(a) for a in at])
            start = (np.concatenate(at) + offsets[text])[:, None] - np.arange(LEFT + 1)[None, :]
            good = (start >= offsets[text][:, None]) & (start + LENGTH <= offsets[text + 1][:, None])
            text, start = np.repeat(text, good.sum(axis=1)), start[good]
            hashes = []
            for base in (_P, _P2):
                sums = np.zeros(len(data) + 1, dtype=U)
                np.cumsum(_OF_BYTE[data] * powers(base, len(data)), dtype=U, out=sums[1:])
                hashes.append(mix(_hash(sums, powers(pow(base, -1, 1 << 64), len(data) + 1), start, start + LENGTH)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[0]), pa.array(hashes[1]), pa.array(ids[first:past][text]), pa.array((start - offsets[text]).astype(np.int32))], ["h", "more", "doc_id", "start"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by hash, doc_id and start: all but the first of each, as spans."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        h, more, doc, start = (batch.column(c).to_numpy() for c in ("h", "more", "doc_id", "start"))
        again = np.concatenate(([last is not None and (h[0], more[0]) == last[:2]], (h[1:] == h[:-1]) & (more[1:] == more[:-1])))
        # The same place, found from two of its anchors, is not a repetition of itself: the first place of a string goes on.
        new = ~again
        index = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first_doc = np.where(index < 0, last[2] if last else 0, doc[np.maximum(index, 0)])
        first_start = np.where(index < 0, last[3] if last else 0, start[np.maximum(index, 0)])
        keep = again & ((doc != first_doc) | (start != first_start))
        last = h[-1], more[-1], first_doc[-1], first_start[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(start[keep]), pa.array((start[keep] + LENGTH).astype(np.int32))], ["doc_id", "start", "end"])


def _runs(ranges: int):
    """For mapInArrow over (doc_id, text, ats, grams): front-coded sorted runs of the suffixes at `ats`, a run for each batch and range of grams."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[tuple]] = {}
            for doc, text, ats, grams in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ats").to_pylist(), batch.column("grams").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for at, gram in zip(ats, grams):
                    found.setdefault(gram % ranges, []).append((raw[at : at + LENGTH], doc, at, raw[max(0, at - LEFT) : at]))
            rows = []
            for key, items in found.items():
                items.sort()
                matrix = np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s, *_ in items), dtype=np.uint8).reshape(-1, LENGTH)
                sizes = np.array([len(s) for s, *_ in items])
                shared = np.zeros(len(items), dtype=np.uint8)
                shared[1:] = np.minimum(np.cumprod(matrix[1:] == matrix[:-1], axis=1).sum(axis=1), np.minimum(sizes[1:], sizes[:-1]))
                rows.append((key, shared.tobytes(), [s[k:] for (s, *_), k in zip(items, shared.tolist())], [x[3] for x in items], [x[1] for x in items], [x[2] for x in items]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RUN_TYPES)], [n for n, _ in _RUN])

    return made


_RUN = [("range", "int"), ("shared", "binary"), ("rests", "array<binary>"), ("lefts", "array<binary>"), ("docs", "array<long>"), ("ats", "array<int>")]
_RUN_TYPES = [pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _unrolled(shared: bytes, rests: list[bytes], *payload: list) -> Iterator[tuple]:
    suffix = b""
    for k, rest, *more in zip(shared, rests, *payload):
        suffix = suffix[:k] + rest
        yield suffix, k, more


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of (suffix, prefix shared with the one before in the run, payload); the same for the whole.

    Every inner node holds the loser of its match with the prefix it shares with that match's winner. A head's known
    prefix is with the last suffix that left: the head with the longer one is smaller, and only equal ones are
    compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = runs + [iter(())] * (k - len(runs))
    heads: list[tuple | None] = [next(r, None) for r in runs]
    known = [0 if h else -1 for h in heads]  # with the empty suffix at first; -1: the run has ended
    losers = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y, i = heads[a][0], heads[b][0], known[a]
        most = min(len(x), len(y))
        while i < most and x[i] == y[i]:
            i += 1
        winner, loser = (a, b) if i == len(x) or i < len(y) and x[i] < y[i] else (b, a)
        if i == len(x) == len(y):
            winner, loser = min(a, b), max(a, b)
        known[loser] = i
        return winner, loser

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = match(play(2 * node), play(2 * node + 1))
        return winner

    top = play(1)
    while known[top] >= 0:
        suffix, _, payload = heads[top]
        yield suffix, known[top], payload
        heads[top] = next(runs[top], None)
        known[top] = heads[top][1] if heads[top] else -1
        node = (top + k) // 2
        while node:
            top, losers[node] = match(top, losers[node])
            node //= 2


def _repeated(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(doc_id, start, end) of the strings around a group's anchors that occur at an earlier anchor of it.

    group: (suffix, prefix shared with the one before, left, doc_id, at). A string that begins o bytes before its anchor
    is what is left of it, o bytes, and the suffix's first LENGTH - o bytes.
    """
    reach = [max(group[i][1] if i else 0, group[i + 1][1] if i + 1 < len(group) else 0) for i in range(len(group))]
    first: dict[tuple[bytes, bytes], tuple[int, int]] = {}
    wide = [(s, left, doc, at, r) for (s, _, left, doc, at), r in zip(group, reach) if r >= LENGTH - len(left)]
    wide.sort(key=lambda x: (x[2], x[3]))
    for suffix, left, doc, at, r in wide:
        for o in range(LENGTH - r, len(left) + 1):
            key = left[len(left) - o :], suffix[: LENGTH - o]
            if key in first:
                yield doc, at - o, at - o + LENGTH
            else:
                first[key] = doc, at


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by range: the repeated strings (doc_id, start, end), joined where they touch."""

    def of(runs: list[tuple]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        group: list[tuple] = []
        for suffix, shared, (left, doc, at) in merged([_unrolled(*r) for r in runs]):
            if shared < GRAM and group:
                if len(group) > 1:
                    found += _repeated(group)
                group = []
                if len(found) > 50_000:
                    yield batch_of(found)
                    found = []
            group.append((suffix, shared, left, doc, at))
        if len(group) > 1:
            found += _repeated(group)
        if found:
            yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        a = np.array(sorted(found), dtype=np.int64)
        new = np.concatenate(([True], (a[1:, 0] != a[:-1, 0]) | (a[1:, 1] > a[:-1, 2])))
        begin = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(a[begin, 0]), pa.array(a[begin, 1].astype(np.int32)), pa.array(np.maximum.reduceat(a[:, 2], begin).astype(np.int32))], ["doc_id", "start", "end"])

    now, runs = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["range"] != now and runs:
                yield from of(runs)
                runs = []
            now = row["range"]
            runs.append((row["shared"], row["rests"], row["lefts"], row["docs"], row["ats"]))
    if runs:
        yield from of(runs)


MET = "doc_id long, at int, gram long, first boolean, context long, more int"


def repeated_spans(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, start, end): bytes that are repeated from earlier; a document's spans may overlap, and end past its text."""
    small_batches(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").where("octet_length(text) >= 100 AND doc_id IS NOT NULL")
    hot = hot_grams(texts)
    rows = texts.mapInArrow(_anchors(hot), "part long, gram long, context long, more int, doc_id long, at int")
    met = written(rows.repartition("part").sortWithinPartitions("gram", "context", "more", "doc_id", "at").mapInArrow(_met(hot), MET))
    if len(hot):
        again = met.where("context IS NOT NULL").select("gram", "context", "more", "doc_id", "at").repartition("context").sortWithinPartitions("gram", "context", "more", "doc_id", "at")
        met = written(met.where("context IS NULL").union(again.mapInArrow(_met(hot), MET)))
    whole = met.where("NOT first").select("doc_id", F.greatest(F.col("at") - LEFT, F.lit(0)).alias("start"), (F.col("at") + LENGTH).alias("end"))
    firsts = met.where("first")
    if len(hot):
        # A hot gram's suffixes would be merged in one task; its strings meet one another by hash instead, each its own key.
        is_hot = F.col("gram").isin(hot.tolist())
        places = firsts.where(is_hot).groupBy(F.col("doc_id").alias("d")).agg(F.sort_array(F.collect_list("at")).alias("ats"))
        strings = texts.join(places, F.col("doc_id") == F.col("d")).select("doc_id", "text", "ats").mapInArrow(_strings, "h long, more long, doc_id long, start int")
        whole = whole.union(strings.repartition("h").sortWithinPartitions("h", "more", "doc_id", "start").mapInArrow(_later, "doc_id long, start int, end int"))
        firsts = firsts.where(~is_hot)
    if ranges is None:  # some 20,000 suffixes each
        ranges = max(12, firsts.count() // 20_000)
    at = firsts.groupBy(F.col("doc_id").alias("d")).agg(F.sort_array(F.collect_list(F.struct("at", "gram"))).alias("s")).select("d", F.col("s.at").alias("ats"), F.col("s.gram").alias("grams"))
    runs = texts.join(at, F.col("doc_id") == F.col("d")).select("doc_id", "text", "ats", "grams").mapInArrow(_runs(ranges), ", ".join(f"{n} {t}" for n, t in _RUN))
    found = runs.repartition("range").sortWithinPartitions("range").mapInArrow(_spans, "doc_id long, start int, end int")
    return whole.union(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if spans:
                gone = np.zeros(len(raw) + 1, dtype=np.int32)
                a = np.minimum(np.array([(s["start"], s["end"]) for s in spans]), len(raw))
                np.add.at(gone, a[:, 0], 1)
                np.add.at(gone, a[:, 1], -1)
                mask = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                out.append((int(mask.sum()), int((mask & ~np.concatenate(([False], mask[:-1]))).sum()), kept))
            else:
                out.append((0, 0, raw))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r + len(k) for r, _, k in out], pa.int64()), pa.array([r for r, *_ in out], pa.int64()), pa.array([n for _, n, _ in out], pa.int64()), pa.array([k for *_, k in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of `docs`; kept: the bytes that are left, in order."""
    spans = repeated_spans(docs)
    lists = spans.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").join(lists, F.col("doc_id") == F.col("d"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
