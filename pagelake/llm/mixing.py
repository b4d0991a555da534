"""Mixing sources to target weights: fixed-length word blocks, drawn through pseudorandom permutations of each source.

1. Each source's words, document after document, form one stream that is packed into blocks of `block` words; what is
   left over at its end is one short block. The running offset is a sum within buckets of documents plus the sum of
   earlier buckets, so a hot source spreads.
2. Targets share `total` times all words by weight; none exceeds `most` times its source, the excess is reshared. A
   target in whole words is a number of slots: so many whole passes over the source's blocks, then further blocks, the
   last of them cut to the words that are missing.
3. Output shards have `shard_slots` slots each. Every slot draws its source by the slots' shares, so the sources' counts
   in a shard are a multinomial draw. What a source drew beyond its slots over all shards, hardly more than the root of
   them, goes in the drawn order to the sources that are short, so that each has its slots exactly.
4. The k-th slot of a source in the order of shards takes block p(k) in its pass, p a keyed Feistel permutation of the
   source's full blocks, walked along its cycle until it stays within them; each pass has a key of its own, and ends in
   the short block. As targets never exceed `most` = 2 passes, no document is used more than twice. Blocks join by index.

Null texts have size 0 and are never taken; rows without doc_id take no part and give no row; a source of null is a
source like any other, ordered last. A very long text spans many blocks, each a row. Empty tables give no rows. Ties in
the order of documents are those of repeated ids: ids must be unique, as `documents` has them. Extra columns are not
read. Draws are hashes of the seed and a slot's number, sums are of whole numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, words_of, written

WEIGHTS = (3, 1, 2)
#: Per-source figures are broadcast up to this many sources, else joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Documents in a bucket of the running offset; on a large corpus their square root.
ROWS_A_BUCKET = 500
#: Words in a block, and slots in an output shard.
BLOCK_WORDS, SHARD_SLOTS = 256, 1024
#: Rounds of the permutation, and steps along its cycle: more than it can need on fewer than CYCLE ** 2 blocks, and on more of them it leaves its range at most once in CYCLE steps.
ROUNDS, CYCLE = 6, 32


def sizes(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select("doc_id", "source", F.size(words_of(F.col("text"), SPACE_WORD)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row a source. Water-filling in closed form.

    With sources sorted by size over weight, the sources that stop at `most` times their size are a prefix; the rest
    share what is left by weight. The windows hold a row of some 100 bytes for each distinct name, so a million sources
    are 100 MB in one task.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    all_words = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(all_words) * F.lit(float(total)))
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source in this order whose share stays within its cap sets the level of all after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_words)
    share = F.coalesce(level["level"] * F.col("weight"), F.col("cap"))
    return per.select("source", "source_size", F.least("cap", share).alias("target"), "weight")


def packed(sized: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """`sized` with `offset`: the document's first word in its source's stream of words. rows: of `sized`, for the buckets."""
    buckets = max(1, rows // max(ROWS_A_BUCKET, int(rows**0.5)))
    salted = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    sums = salted.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = salted.withColumn("_run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = run.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return joined.select(*sized.columns, (F.col("_start") + F.col("_run")).alias("offset"))


def _running(df: DataFrame, within: list[str], order: str, n: str, name: str, bucket_rows: int = 4096) -> DataFrame:
    """`df` with `name`, the sum of `n` over earlier rows by `order` (a whole number from 0, unique within `within`).

    Sums within buckets of the order and sums of buckets, so that no task holds more than a bucket of a group's rows.
    """
    keyed = df.withColumn("_bucket", F.expr(f"{order} div {bucket_rows}"))
    sums = keyed.groupBy(*within, "_bucket").agg(F.sum(n).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*within, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("_run", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    same = F.col("_bucket") == F.col("_b")
    for c in within:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return run.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_run")).cast("long").alias(name))


def source_slots(targets: DataFrame, block: int) -> DataFrame:
    """(source, code, full, blocks, slots, last_words): each source with words, numbered by `code`; its blocks, how many of
    them are full, its slots in the mix, and the words of the last one."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = targets.where("source_size > 0 AND target >= 0.5").withColumn("code", F.row_number().over(order) - 1).withColumn("words", F.round("target").cast("long"))
    per = per.withColumn("full", F.expr(f"source_size div {block}")).withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}"))
    rest = "words % source_size"
    slots = F.expr(f"words div source_size * blocks + ({rest} + {block} - 1) div {block}")
    last = F.expr(f"if({rest} = 0, {block}, {rest} - ({rest} - 1) div {block} * {block})")
    return per.select("source", "code", "full", "blocks", slots.alias("slots"), last.alias("last_words"))


def shard_counts(per: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(code, shard, k, c): source `code` has c slots of the shard, the k-th and later ones of the source.

    per: `source_slots`; slots: the sum of its slots. Each slot draws a number below `slots` and takes the source whose
    range of the shares it falls in. The ranges are cut at a grid, so that the join is by equality of grid cells, of
    which the widest source has most.
    """
    spark = per.sparkSession
    cells = 4096
    upto = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = per.select("code", "slots", F.sum("slots").over(upto).alias("past")).withColumn("from", F.col("past") - F.col("slots"))
    cell = lambda x: F.expr(f"cast({x} * {cells} div {slots} AS int)")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(cell("cast(`from` AS decimal(38,0))"), cell("cast(past - 1 AS decimal(38,0))"))))
    tasks = max(4, -(-slots // (shard_slots * 1024)))
    drawn = spark.range(0, slots, 1, tasks).select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(slots)).alias("u"))
    drawn = drawn.withColumn("at", cell("cast(u AS decimal(38,0))"))
    hit = (F.col("at") == F.col("cell")) & (F.col("u") >= F.col("from")) & (F.col("u") < F.col("past"))
    # A hint, as a table that Spark thinks small may grow with the corpus; the ranges are 4096 and one a source.
    ranges = F.broadcast(ranges) if per.count() <= BROADCAST_SOURCES else ranges.hint("shuffle_hash")
    counts = written(drawn.join(ranges, hit).groupBy("code", "shard").agg(F.count("*").alias("c")))
    placed = _running(counts, ["code"], "shard", "c", "k")
    limit = per.select(F.col("code").alias("_code"), F.col("slots").alias("_slots"))
    placed = written(placed.join(limit, F.col("code") == F.col("_code")).select("code", "shard", "k", "c", F.expr("greatest(0L, least(c, _slots - k))").alias("kept"), "_slots"))
    # Freed slots in the order of shards, and missing ones in the order of sources, meet by number.
    freed = placed.where("kept < c").groupBy("shard").agg(F.sum(F.col("c") - F.col("kept")).alias("n"))
    freed = freed.withColumn("unit", F.explode(F.expr("sequence(1L, n)"))).select("shard", F.struct("shard", "unit").alias("o"))
    have = placed.groupBy("code").agg(F.sum("kept").alias("have"))
    short = limit.join(have, F.col("_code") == F.col("code"), "left").select(F.col("_code").alias("code"), F.coalesce("have", F.lit(0)).alias("have"), "_slots")
    short = short.where("have < _slots").withColumn("k", F.explode(F.expr("sequence(have, _slots - 1)"))).select("code", "k")
    # One task each: about the root of the slots of each source.
    freed = freed.withColumn("i", F.row_number().over(Window.orderBy("o"))).select("shard", "i")
    short = short.withColumn("j", F.row_number().over(Window.orderBy("code", "k")))
    given = short.join(freed.hint("merge"), F.col("i") == F.col("j")).select("code", "shard", "k", F.lit(1).cast("long").alias("c"))
    return placed.where("kept > 0").select("code", "shard", "k", F.col("kept").alias("c")).union(given)


def permuted(k: str, n: str, key: str) -> str:
    """SQL for the place of k among n under the keyed permutation: Feistel rounds over the pairs (x, y) of a grid of
    a * b >= n cells, hardly more, repeated while the result is n or more."""
    step = """if(i % 2 = 0, named_struct('x', (v.x + pmod(xxhash64(g.key, i, v.y), g.a)) % g.a, 'y', v.y),
      named_struct('x', v.x, 'y', (v.y + pmod(xxhash64(g.key, i, v.x), g.b)) % g.b))"""
    once = f"aggregate(sequence(1, {ROUNDS}), named_struct('x', z div g.b, 'y', z % g.b), (v, i) -> {step}, v -> v.x * g.b + v.y)"
    walk = f"aggregate(sequence(1, {CYCLE}), {once.replace('z ', 'g.k ')}, (z, j) -> if(z < g.n, z, {once}), z -> if(z < g.n, z, cast(raise_error('the permutation left its range') AS bigint)))"
    side = f"cast(ceil(sqrt({n})) AS bigint)"
    grid = f"array(named_struct('k', {k}, 'n', {n}, 'key', {key}, 'a', {side}, 'b', ({n} + {side} - 1) div {side}))"
    return f"transform({grid}, g -> {walk})[0]"


def drawn_blocks(targets: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(source, block_id, epoch, shard, slot, words): the slots of the mix, as a table: which block each takes in which
    pass, and how many of its words."""
    per = written(source_slots(targets, block).coalesce(1))
    slots = per.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    counts = shard_counts(per, max(slots, 1), shard_slots, seed)
    sources = per.select(F.col("code").alias("_code"), "source", "full", "blocks", "slots", "last_words")
    sources = F.broadcast(sources) if per.count() <= BROADCAST_SOURCES else sources
    each = counts.join(sources, F.col("code") == F.col("_code")).withColumn("k", F.explode(F.expr("sequence(k, k + c - 1)")))
    key = f"xxhash64(code, k div blocks, {seed})"
    at = F.expr(f"if(k % blocks >= full, full, {permuted('k % blocks', 'full', key)})")
    words = F.when(F.expr("k = slots - 1"), F.col("last_words")).otherwise(F.lit(block))
    return written(each.select("source", at.alias("block_id"), F.expr("k div blocks").alias("epoch"), "shard", F.xxhash64("code", "k", F.lit(seed)).alias("slot"), words.alias("words")))


def _overlap(block: int) -> str:
    return f"least(offset + size, (block_id + 1) * {block}) - greatest(offset, block_id * {block})"


def mixture(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size and offset, targets, drawn blocks)."""
    if most > 2:
        raise ValueError("most must be 2 or less")
    sized = written(sizes(docs))
    rows = sized.count()
    targets = written(source_targets(sized, weights, total, most).coalesce(1))
    return packed(sized, rows, seed), targets, drawn_blocks(targets, block, seed=seed)


def taken_words(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: size, source_size, target, taken."""
    placed, targets, drawn = mixture(docs, weights, total, most, seed, block)
    placed = written(placed)
    uses = drawn.groupBy(F.col("source").alias("_u"), F.col("block_id").alias("_i")).agg(F.collect_list("words").alias("uses"))  # 2 at most
    parts = placed.where("size > 0").withColumn("block_id", F.explode_outer(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")))
    parts = parts.select("doc_id", "source", "block_id", F.expr(f"greatest(offset - block_id * {block}, 0)").alias("from"), F.expr(_overlap(block)).alias("part"))
    met = parts.join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("_u")) & (F.col("block_id") == F.col("_i")))
    part = F.expr("aggregate(uses, 0L, (a, w) -> a + greatest(0L, least(part, w - `from`)))")
    took = met.groupBy(F.col("doc_id").alias("_d")).agg(F.sum(part).alias("taken"))
    out = placed.select("doc_id", "source", "size").join(took.hint("merge"), F.col("doc_id") == F.col("_d"), "left")
    per = targets.select(F.col("source").alias("_t"), "source_size", "target")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    return out.join(per, F.col("source").eqNullSafe(F.col("_t")), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_pieces(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: (shard, slot, source, block_id, epoch, offset, doc_id, piece, n_words), a row for each document's part of a drawn block."""
    placed, _, drawn = mixture(docs, weights, total, most, seed, block)
    texts = docs.select(F.col("doc_id").alias("_d"), words_of(F.col("text"), SPACE_WORD).alias("_w"))
    cut = f"transform(sequence(offset div {block}, (offset + size - 1) div {block}), block_id -> struct(block_id AS b, greatest(offset, block_id * {block}) AS o, slice(_w, cast(greatest(offset, block_id * {block}) - offset + 1 AS int), cast({_overlap(block)} AS int)) AS w))"
    parts = placed.where("size > 0").join(texts, F.col("doc_id") == F.col("_d")).select("doc_id", F.col("source").alias("_s"), F.explode_outer(F.expr(cut)).alias("c"))
    parts = parts.select("doc_id", "_s", F.col("c.b").alias("_b"), F.col("c.o").alias("offset"), F.array_join("c.w", " ").alias("piece"), F.size("c.w").cast("long").alias("part"))
    n = F.least(F.col("part"), F.expr(f"words - (offset - block_id * {block})"))
    met = drawn.join(parts.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block_id") == F.col("_b"))).withColumn("n_words", n).where("n_words > 0")
    # Only the last slot of a source cuts a piece.
    piece = F.when(F.col("n_words") == F.col("part"), F.col("piece")).otherwise(F.expr("array_join(slice(split(piece, ' '), 1, cast(n_words AS int)), ' ')"))
    return met.select("shard", "slot", "source", "block_id", "epoch", "offset", "doc_id", piece.alias("piece"), "n_words")


def op10(spark, sf_dir: str) -> DataFrame:
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
