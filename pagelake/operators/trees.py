"""Trees of any depth over whole tables: running counts and minima by blocks, parents by windows, lineages by doubling.

No book is one group: what runs along a book's rows is first worked out in blocks of ords, then over the blocks' summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Ords of a book in one window.
BLOCK = 20_000


def running(rows: DataFrame, name: str, value: Column, kind=F.sum) -> DataFrame:
    """`rows` (book_id, ord, …) with `name`: the sum (or minimum) of `value` over a book's rows up to each."""
    rows = rows.withColumn("_block", F.floor(F.col("ord") / BLOCK)).withColumn("_value", value)
    upto = Window.partitionBy("book_id", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("book_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", kind("_value").over(upto))
    blocks = rows.groupBy("book_id", "_block").agg(kind("_value").alias("_whole")).withColumn("_before", kind("_whole").over(earlier)).drop("_whole")
    both = F.least("_near", "_before") if kind is F.min else F.col("_near") + F.coalesce("_before", F.lit(0))
    joined = near.withColumnRenamed("book_id", "_book").join(blocks.withColumnRenamed("_block", "_b"), F.col("_book").eqNullSafe(F.col("book_id")) & (F.col("_block") == F.col("_b")), "left")
    return joined.select(*[F.col("_book").alias("book_id") if c == "book_id" else F.col(c) for c in rows.columns if c not in ("_block", "_value", name)], both.alias(name))


def last_before(rows: DataFrame, key: str, held: Column, sought: Column, name: str) -> DataFrame:
    """`rows` (book_id, ord, …) with `name`: the ord of the last earlier row of the book one of whose `held` keys is the row's own `sought`.

    held: an array of keys, sought: one key. A block of ords is a window of its own, then one over the blocks' last.
    """
    rows = rows.withColumn("_sought", sought).withColumn("_block", F.floor(F.col("ord") / BLOCK))
    giving = rows.select("book_id", F.explode(held).alias(key), "_block", "ord", F.col("ord").alias("_given"))
    asking = rows.select("book_id", F.col("_sought").alias(key), "_block", "ord", F.lit(None).cast("long").alias("_given"))
    # A row that asks comes before what rows of its own ord give.
    order = Window.partitionBy("book_id", key, "_block").orderBy("ord", F.col("_given").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = giving.union(asking).withColumn("_near", F.last("_given", ignorenulls=True).over(order)).where("_given IS NULL")
    earlier = Window.partitionBy("_b", "_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = giving.union(asking).groupBy(F.col("book_id").alias("_b"), F.col(key).alias("_k"), F.col("_block").alias("_at")).agg(F.max("_given").alias("_last"))
    far = blocks.withColumn("_far", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    found = near.join(far, F.col("book_id").eqNullSafe(F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_at")), "left")
    found = found.select(F.col("book_id").alias("_b"), F.col("ord").alias("_o"), F.coalesce("_near", "_far").alias(name))
    return rows.drop("_sought", "_block").join(found, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("ord") == F.col("_o")), "left").drop("_b", "_o")


def lineages(rows: DataFrame, key: str, parent: str, part: Column) -> DataFrame:
    """`rows` (book_id, key, parent, …) with `lineage`: the parts from the root down to the row, in as many rounds as the
    depth has binary digits. Rows that reach no root, by a parent that isn't there or in a circle, are left out."""
    found = written(rows.withColumn("lineage", F.array(part)).withColumn("_up", F.col(parent)))
    # A lineage is no longer than there are rows, so what is still under way after as many rounds as that has digits is a circle.
    for _ in range(found.count().bit_length() + 1):
        if found.where("_up IS NOT NULL").isEmpty():
            break
        up = found.select(F.col("book_id").alias("_b"), F.col(key).alias("_i"), F.col("lineage").alias("_l"), F.col("_up").alias("_u"))
        met = found.join(up, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("_up") == F.col("_i")), "left").where("_up IS NULL OR _i IS NOT NULL")
        further = F.when(F.col("_i").isNull(), F.col("lineage")).otherwise(F.concat("_l", "lineage"))
        found = written(met.withColumns({"lineage": further, "_up": F.col("_u")}).drop("_b", "_i", "_l", "_u"))
    return found.where("_up IS NULL").drop("_up")
