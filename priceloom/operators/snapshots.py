"""Snapshots of price lists over time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X


def item_key() -> Column:
    return F.when(F.col("product_id").isNotNull(), F.concat(F.lit("id:"), "product_id")).otherwise(F.concat(F.lit("name:"), X.name_key(F.col("product_name"))))


def build(offers: DataFrame) -> DataFrame:
    """Per supplier and item the last offer."""
    rows = offers.withColumn("key", item_key())
    return rows.groupBy("supplier", "key").agg(F.max_by(F.struct("product_name", "price"), "pos").alias("last")).select("supplier", "key", "last.*")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """supplier, key, status (new, removed, changed) and both prices; items that stay as they are have no row."""
    a, b = old.select("supplier", "key", F.col("price").alias("old_price")), new.select("supplier", "key", F.col("price").alias("new_price"))
    status = F.when(F.col("old_price").isNull(), "new").when(F.col("new_price").isNull(), "removed").when(F.abs(F.col("old_price") - F.col("new_price")) >= 0.01, "changed")
    return a.join(b, ["supplier", "key"], "full").withColumn("status", status).filter("status IS NOT NULL")


def latest_sessions(sessions: DataFrame, most: int = 5) -> DataFrame:
    """The `most` latest sessions of each supplier; supplier, session, updated_at."""
    return sessions.withColumn("rank", F.row_number().over(Window.partitionBy("supplier").orderBy(F.desc("updated_at"), "session"))).filter(F.col("rank") <= most)


def trend(prices: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """Each value with the one before it in its group, and up, down or same (within 0.0001)."""
    rows = prices.withColumn("before", F.lag(value).over(Window.partitionBy(group).orderBy(*at.split(","))))
    return rows.withColumn("trend", F.when(F.abs(F.col(value) - F.col("before")) < 0.0001, "same").when(F.col(value) > F.col("before"), "up").when(F.col(value) < F.col("before"), "down"))


def section_breaks(rows: DataFrame, group: str, order: list[str], category: str) -> DataFrame:
    """Rows at which a list's category changes; the first of each list is one."""
    before = F.lag(category).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col(category))).drop("before")


def history(entries: DataFrame, most: int = 300) -> DataFrame:
    """The `most` entries that finished last, newest first."""
    return entries.orderBy(F.desc("finished_at"), "entry").limit(most)


def diff_summary(old: DataFrame, new: DataFrame, most: int = 10) -> DataFrame:
    """Per supplier how many items are new, new without an id, removed and changed, with up to `most` keys of each in order."""
    rows = diff(old, new)
    rank = F.row_number().over(Window.partitionBy("supplier", "status").orderBy("key"))
    ranked = rows.withColumn("rank", rank)
    of = lambda s: F.count_if(F.col("status") == s)
    first = lambda s: F.array_join(F.array_sort(F.collect_list(F.when((F.col("status") == s) & (F.col("rank") <= most), F.col("key")))), "; ")
    return ranked.groupBy("supplier").agg(
        of("new").alias("n_new"), F.count_if((F.col("status") == "new") & F.col("key").startswith("name:")).alias("n_new_without_id"), of("removed").alias("n_removed"), of("changed").alias("n_changed"),
        first("new").alias("new_keys"), first("removed").alias("removed_keys"),
    )
