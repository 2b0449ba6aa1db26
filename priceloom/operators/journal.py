"""Changes of ids: bulk clearing, the journal of changes, and undoing a batch."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clear_ids(offers: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """The offers with the ids cleared where the test holds, and the changes (pos, old_id, new_id)."""
    hit = F.coalesce(where, F.lit(False)) & F.col("product_id").isNotNull()
    changes = offers.filter(hit).select("pos", F.col("product_id").alias("old_id"), F.lit(None).cast("string").alias("new_id"))
    return offers.withColumn("product_id", F.when(~hit, F.col("product_id"))), changes


def rollback(offers: DataFrame, changes: DataFrame) -> DataFrame:
    """The offers as they were before the changes, where they still hold what the changes wrote."""
    rows = offers.join(changes, "pos", "left")
    undo = F.col("old_id").isNotNull() & F.col("product_id").eqNullSafe(F.col("new_id"))
    return rows.withColumn("product_id", F.when(undo, F.col("old_id")).otherwise(F.col("product_id"))).drop("old_id", "new_id")


def latest(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key, by `at`."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), at).alias("row")).select(*keys, "row.*")


def fresh(events: DataFrame, keys: list[str], at: str, now, seconds: int) -> DataFrame:
    """The last row of each key that is no older than `seconds` before now."""
    return latest(events, keys, at).filter(F.col(at) >= F.lit(now) - F.make_dt_interval(secs=F.lit(seconds)))


def cascade(offers: DataFrame, changes: DataFrame, cache: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cache (key, product_id) and bindings (name_key, bound_id) without the ids that the changes took away from every offer."""
    gone = changes.select(F.col("old_id").alias("product_id")).distinct().join(offers.select("product_id").distinct(), "product_id", "left_anti")
    return cache.join(gone, "product_id", "left_anti"), bindings.join(gone.withColumnRenamed("product_id", "bound_id"), "bound_id", "left_anti")
