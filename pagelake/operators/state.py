"""Snapshots of keyed tables: merges, deletions, clamps and legal transitions. Each returns the new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From which states a job may be paused, resumed or cancelled, and what it is then; live states, most urgent first.
TRANSITIONS = {"pause": ("queued", "running", "paused"), "resume": ("paused", "failed"), "cancel": ("queued", "running", "paused")}
OUTCOMES = {"pause": "paused", "resume": "queued", "cancel": "cancelled"}
URGENCY = ("running", "queued", "paused", "failed")


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; what plain Parquet has in place of an upsert."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def upserted(existing: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`existing` with `changes` (same columns) put in; on equal `order` the change wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_wins(both, keys, [F.col(order), F.col("_new")]).drop("_new")


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `wanted` that have no equal row in `existing`: new, changed, or of another model."""
    return wanted.join(existing.select(*keys), keys, "left_anti")


def still_wanted(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(wanted.select(*keys), keys, "left_semi")


def without_book(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """A table without the rows of deleted books: the cascade, table by table."""
    return table.join(deleted.select("book_id"), "book_id", "left_anti")


def clamped(value: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(value, low), high)


def transition_valid(action: Column, status: Column) -> Column:
    checks = [(action == a) & status.isin(*allowed) for a, allowed in TRANSITIONS.items()]
    valid = checks[0]
    for c in checks[1:]:
        valid = valid | c
    return valid


def transitioned(jobs: DataFrame) -> DataFrame:
    """`jobs` (…, action, status, attempts, claim_id) after their action: what isn't allowed changes nothing and isn't `ok`.

    A resumed job has no claim, and one that had failed starts counting its attempts anew. Null actions aren't allowed.
    """
    ok = F.coalesce(transition_valid(F.col("action"), F.col("status")), F.lit(False))
    resumed = ok & (F.col("action") == "resume")
    outcomes = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return jobs.withColumns({
        "ok": ok, "status": F.when(ok, outcomes[F.col("action")]).otherwise(F.col("status")),
        "attempts": F.when(resumed & (F.col("status") == "failed"), 0).otherwise(F.col("attempts")), "claim_id": F.when(~resumed, F.col("claim_id")),
    })


def queue_order(jobs: DataFrame) -> DataFrame:
    """(…, position): queued jobs of each book by priority, then age, then id."""
    order = Window.partitionBy("book_id").orderBy(F.col("priority").desc(), "created_at", "job_id")
    return jobs.where("status = 'queued'").withColumn("position", F.row_number().over(order))


def latest_per_kind(jobs: DataFrame) -> DataFrame:
    """The newest live job of each book and kind, with its urgency (0 first); completed and cancelled ones hide none."""
    newest = latest_wins(jobs.where(F.col("status").isin(*URGENCY)), ["book_id", "kind"], [F.col("updated_at"), F.col("job_id")])
    return newest.withColumn("urgency", F.array_position(F.array(*map(F.lit, URGENCY)), F.col("status")) - 1)


def quota(attempts: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """`attempts` with `outcome`: executed while at most `most` were made under the key, then rejected."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return attempts.withColumn("outcome", F.when(n <= most, "executed").otherwise("rejected"))


def covered_prefix(pages: DataFrame) -> DataFrame:
    """(book_id, prefix, pages): how many leading pages are covered without a gap, of (book_id, page, covered)."""
    first_gap = F.min(F.when(~F.col("covered"), F.col("page")))
    return pages.groupBy("book_id").agg((F.coalesce(first_gap, F.max("page") + 1) - 1).cast("long").alias("prefix"), F.count("*").alias("pages"))
