"""Market statistics and markups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import pricing
from priceloom.sources.tables import with_known


def _by_price(prices: DataFrame) -> DataFrame:
    """product_id, price, n with low, high, offers, cents and mean of the product: equal prices are counted first, so that a
    product with very many offers is small before it meets in one place."""
    rows = prices.filter("price > 0").groupBy("product_id", "price").agg(F.count("*").alias("n"))
    own = Window.partitionBy("product_id")
    rows = rows.withColumns({"low": F.min("price").over(own), "high": F.max("price").over(own), "offers": F.sum("n").over(own), "cents": F.sum(F.round(F.col("price") * 100) * F.col("n")).over(own)})
    return rows.withColumn("mean", F.col("cents") / F.col("offers") / 100)


def near_average() -> Column:
    """Within 5 % of the mean, or within 1."""
    return F.abs(F.col("price") - F.col("mean")) <= F.greatest(F.lit(1.0), F.col("mean") * 0.05)


def market_stats(prices: DataFrame) -> DataFrame:
    """Per product_id: min, avg and max price, offers, and how many lie within 2 % of the minimum or near the average."""
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    # The average of whole cents, halves upwards: the same on every engine.
    average = F.floor((2 * F.first("cents") + F.first("offers")) / (2 * F.first("offers"))) / 100
    return _by_price(prices).groupBy("product_id").agg(
        F.round(F.first("low"), 2).alias("min_price"), average.alias("avg_price"), F.round(F.first("high"), 2).alias("max_price"), F.first("offers").alias("offers"),
        count(F.col("price") <= F.col("low") * 1.02).alias("min_competitors"), count(near_average()).alias("avg_competitors"),
    )


def enrich(offers: DataFrame, stats: DataFrame, oldest: int | None = None) -> DataFrame:
    """Offers with the market columns of their id; stats older than `oldest` (epoch seconds) are not used."""
    fresh = stats if oldest is None else stats.filter(F.col("updated_at") >= oldest)
    return with_known(offers, fresh, "product_id")


def apply_markups(offers: DataFrame, config: DataFrame, missing_market: str = "wholesale") -> DataFrame:
    """Adds retail and no_discount by the category's rule (category, percent, threshold, min_profit,
    no_discount_percent, base_mode). Without a market price for base_mode an offer falls back to its own price, or is
    left out with missing_market="skip"."""
    base = F.when(F.col("base_mode") == "wholesale", F.col("price"))
    for mode in ("min", "avg", "max"):
        base = base.when(F.col("base_mode") == f"market_{mode}", F.col(f"{mode}_price"))
    rows = offers.join(config, "category").withColumn("base", base)
    rows = rows.filter("base IS NOT NULL") if missing_market == "skip" else rows.withColumn("base", F.coalesce("base", "price"))
    retail = pricing.retail_price(F.col("base"), F.col("percent"), F.col("threshold"), F.col("min_profit"))
    return rows.withColumn("retail", retail).withColumn("no_discount", pricing.undiscounted_price(F.col("retail"), F.col("no_discount_percent")))


def nearest_offers(prices: DataFrame, kind: str = "min", most: int = 8) -> DataFrame:
    """Of each product the `most` offers nearest to its minimum (within 2 %), average (within 5 % or 1) or maximum (within 2 %), as a list in that order."""
    priced = prices.filter("price IS NOT NULL")
    order = {"min": [F.col("price")], "max": [F.desc("price")], "avg": [F.abs(F.col("price") - F.col("mean"))]}[kind]
    if kind == "avg":
        priced = priced.join(_by_price(priced).groupBy("product_id").agg(F.first("mean").alias("mean")), "product_id").filter(near_average())
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(*order, "price", "supplier"))
    first = priced.withColumn("rank", rank).filter(F.col("rank") <= most)
    edge = {"min": F.min("price"), "max": F.max("price"), "avg": F.lit(None).cast("double")}[kind]
    rows = first.groupBy("product_id").agg(edge.alias("edge"), F.array_sort(F.collect_list(F.struct("rank", "price", "supplier"))).alias("near"))
    within = {"min": lambda x: x["price"] <= F.col("edge") * 1.02, "max": lambda x: x["price"] >= F.col("edge") * 0.98, "avg": lambda x: F.lit(True)}[kind]
    return rows.select("product_id", F.transform(F.filter("near", within), lambda x: F.struct(x["price"].alias("price"), x["supplier"].alias("supplier"))).alias("near")).filter("size(near) > 0")


def due(refreshed: DataFrame, now: int, hours: Column) -> DataFrame:
    """Rows (updated_at in epoch seconds, null if never) whose refresh is due; other intervals than 3, 6 and 12 hours count as 6."""
    every = F.when(hours.isin(3, 6, 12), hours).otherwise(6)
    return refreshed.filter(F.col("updated_at").isNull() | (F.lit(now) - F.col("updated_at") >= every * 3600))


def merge_refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics (product_id, min_price, avg_price, max_price, updated_at) after a refresh: an old value stays where the new one has none."""
    values = ["min_price", "avg_price", "max_price"]
    joined = old.select("product_id", *[F.col(c).alias(f"old_{c}") for c in [*values, "updated_at"]]).join(new.select("product_id", *values, "updated_at"), "product_id", "full")
    some = F.coalesce(*values).isNotNull()
    return joined.select("product_id", *[F.when(some, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in values], F.greatest("updated_at", "old_updated_at").alias("updated_at"))
