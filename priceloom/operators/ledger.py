"""Decisions about ids, kept as an append-only log of versions.

Items are what decisions are about: a supplier's product by its name key, with the id that it came with. The log holds rows
(batch, kind, supplier, name_key, product_id, undone): `set` gives an item an id (null clears it), `undo` takes back what the
batch `undone` set. Nothing in it is ever changed. The state of an item is found by replay: the id of its last set whose batch
was not undone, else the one it came with; its version is the number of the last batch that touched it, by setting or undoing, 0 if none.

A decision names the version that it saw. judge() refuses it as `gone` if the item isn't there (any more), `stale` if the item
has another version by now, `conflict` if another item of the supplier has the id, `later` if an earlier decision of the batch
holds the item, and `taken` if an earlier one of the batch gives the id to another item. So each item changes once a batch, and
an accepted batch can be appended as it is. A batch's decisions are ordered by `number`; equal ones by what they say.
Rejections (action `reject`) give no id: they set null and block the id for the item, which later decisions respect (`blocked`).

Null suppliers count as one supplier, null and blank name keys name no item. Repeated items count once, with the smallest id;
repeated decisions are `later` than the first. Empty tables give empty results.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "batch long, kind string, supplier string, name_key string, product_id string, undone long, blocked string"
ITEM = ["supplier", "name_key"]


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def append(path: str, rows: DataFrame) -> None:
    """Add rows to the log in that folder; files that are there stay."""
    rows.write.mode("append").parquet(path)


def items_of(offers: DataFrame) -> DataFrame:
    """supplier (blank for null), name_key, product_id: the items of offers that have a name_key; of several ids the shortest and smallest."""
    named = offers.filter(F.coalesce("name_key", F.lit("")) != "")
    least = F.min(F.when(F.col("product_id").isNotNull(), F.struct(F.length("product_id").alias("n"), "product_id")))
    return named.groupBy(F.coalesce("supplier", F.lit("")).alias("supplier"), "name_key").agg(least["product_id"].alias("product_id"))


def undone_batches(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'undo'").select(F.col("undone").alias("batch")).distinct()


def state(items: DataFrame, log: DataFrame) -> DataFrame:
    """supplier, name_key, product_id, version of the items (supplier, name_key, product_id) after the whole log."""
    touched = log.groupBy(*ITEM).agg(F.max("batch").alias("version"))
    last = log.filter("kind = 'set'").join(undone_batches(log), "batch", "left_anti").groupBy(*ITEM).agg(F.max_by(F.struct("product_id"), "batch").alias("last"))
    rows = items.join(touched, ITEM, "left").join(last, ITEM, "left")
    return rows.select(*ITEM, F.when(F.col("last").isNotNull(), F.col("last.product_id")).otherwise(F.col("product_id")).alias("product_id"), F.coalesce("version", F.lit(0)).cast("long").alias("version"))


def blocked_ids(log: DataFrame) -> DataFrame:
    """supplier, name_key, blocked: the ids that rejections keep from items, but for those undone."""
    return log.filter("kind = 'set' AND blocked IS NOT NULL").join(undone_batches(log), "batch", "left_anti").select(*ITEM, "blocked").distinct()


def judge(decisions: DataFrame, now: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """The decisions (number, supplier, name_key, action: confirm, clear or reject, product_id, seen, duplicates: whether the id may be another item's too) with `outcome`: accepted, or why not.

    now: the state() of the items; blocked: blocked_ids().
    """
    rows = decisions.withColumns({"supplier": F.coalesce("supplier", F.lit("")), "sets": F.when(F.col("action") == "confirm", F.col("product_id")), "free": F.coalesce("duplicates", F.lit(False))})
    held = now.filter("product_id IS NOT NULL").select("supplier", F.col("product_id").alias("sets"), F.col("name_key").alias("holder"))
    # Whether another item has the id: one holder and how many there are tell it without listing them.
    holders = held.groupBy("supplier", "sets").agg(F.count("*").alias("n"), F.min("holder").alias("holder"))
    rows = rows.join(now.select(*ITEM, "version"), ITEM, "left").join(holders, ["supplier", "sets"], "left")
    others = F.coalesce((F.col("n") > 1) | (F.col("holder") != F.col("name_key")), F.lit(False))
    if blocked is not None:
        rows = rows.join(blocked.select(*ITEM, F.col("blocked").alias("sets"), F.lit(True).alias("is_blocked")).distinct(), [*ITEM, "sets"], "left")
    else:
        rows = rows.withColumn("is_blocked", F.lit(False))
    first = (
        F.when(F.col("version").isNull(), "gone")
        .when(~F.col("version").eqNullSafe(F.col("seen")), "stale")
        .when(F.coalesce("is_blocked", F.lit(False)), "blocked")
        .when((F.col("action") == "confirm") & F.col("product_id").isNull(), "no_id")
        .when(others & ~F.col("free"), "conflict")
    )
    rows = rows.withColumn("refused", first)
    order = ["number", "action", "product_id"]
    own = Window.partitionBy(*ITEM, F.col("refused").isNull()).orderBy(*order)
    rows = rows.withColumn("refused", F.when(F.col("refused").isNull() & (F.row_number().over(own) > 1), "later").otherwise(F.col("refused")))
    # Each item is in it once now, so the first decision on an id is the only one of its item.
    claim = Window.partitionBy("supplier", "sets", F.col("refused").isNull()).orderBy(*order)
    taken = F.col("refused").isNull() & F.col("sets").isNotNull() & ~F.col("free") & (F.row_number().over(claim) > 1)
    return rows.withColumn("outcome", F.when(taken, "taken").otherwise(F.coalesce("refused", F.lit("accepted")))).select(*decisions.columns, "outcome")


def log_rows(judged: DataFrame, batch: int) -> DataFrame:
    """What the accepted decisions add to the log, as that batch."""
    rows = judged.filter("outcome = 'accepted'")
    confirm = F.col("action") == "confirm"
    return rows.select(
        F.lit(batch).cast("long").alias("batch"), F.lit("set").alias("kind"), F.coalesce("supplier", F.lit("")).alias("supplier"), "name_key",
        F.when(confirm, F.col("product_id")).alias("product_id"), F.lit(None).cast("long").alias("undone"), F.when(F.col("action") == "reject", F.col("product_id")).alias("blocked"),
    )


def undo_last(log: DataFrame, batch: int) -> DataFrame:
    """What undoing the last batch that is not undone yet adds to the log, as a batch of its own: a row for each item that it set. None of it if there is no such batch."""
    sets = log.filter("kind = 'set'").join(undone_batches(log), "batch", "left_anti")
    last = sets.agg(F.max("batch").alias("batch")).filter("batch IS NOT NULL")  # one row
    none = F.lit(None).cast("string")
    return sets.join(F.broadcast(last), "batch").select(F.lit(batch).cast("long").alias("batch"), F.lit("undo").alias("kind"), *ITEM, none.alias("product_id"), F.col("batch").alias("undone"), none.alias("blocked")).distinct()
