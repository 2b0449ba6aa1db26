"""Offers to the best offer per product. Every choice of a row starts before the shuffle."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.sources.tables import with_known


def row_key(place: Column | None = None) -> Column:
    """What tells a supplier's offers apart: the code, else the name, else the place in its list, if that is given."""
    key = X.name_key(F.col("product_name"))
    placed = F.concat(F.lit("row:"), place.cast("string")) if place is not None else F.lit("name:")
    named = F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit("name:"), key)).otherwise(placed)
    return F.when(F.coalesce(X.strip(F.col("supplier_code")), F.lit("")) != "", F.concat(F.lit("code:"), X.strip(F.col("supplier_code")))).otherwise(named)


def _price_order() -> Column:
    """Unreadable prices come last; then the place in the list decides."""
    return F.struct(F.coalesce(F.col("price"), F.lit(float("inf"))).alias("price"), "pos")


def keep_lowest(offers: DataFrame) -> DataFrame:
    """The cheapest offer of each id; offers without one pass through. Spark drops all but the first of an id before the shuffle too."""
    order = Window.partitionBy("product_id").orderBy(F.coalesce("price", F.lit(float("inf"))), "pos")
    best = offers.filter("product_id IS NOT NULL").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    return best.unionByName(offers.filter("product_id IS NULL"))


def consolidate(offers: DataFrame) -> DataFrame:
    """One row per (id, supplier, key), or (supplier, key) without an id: the cheapest offer, the longest warranty, and
    the first delivery term of the group."""
    keyed = offers.withColumn("row_key", row_key())
    grouped = keyed.groupBy("product_id", "supplier", "row_key").agg(
        F.min_by(F.struct("product_name", "price", "rrp", "category"), _price_order()).alias("best"),
        F.max("warranty").alias("warranty"),
        F.min_by("delivery", F.when(F.col("delivery").isNotNull(), F.col("pos"))).alias("delivery"),
    )
    return grouped.select("product_id", "supplier", "row_key", "best.*", "warranty", X.delivery_days(F.col("delivery")).alias("delivery_days"))


def price_matrix(offers: DataFrame, suppliers: list[str]) -> DataFrame:
    """Per id the lowest price of each listed supplier, the cheapest one, and the longest warranty over all offers."""
    rows = offers.filter("product_id IS NOT NULL")
    columns = [F.min(F.when(F.col("supplier") == s, F.col("price"))).alias(f"price_{k}") for k, s in enumerate(suppliers, 1)]
    return rows.groupBy("product_id").agg(
        F.min_by("product_name", "pos").alias("product_name"), *columns, F.min("price").alias("min_price"),
        F.min_by("supplier", _price_order()).alias("best_supplier"), F.max("warranty").alias("warranty"),
    )


def clear_repeated_ids(offers: DataFrame, suppliers: Column) -> DataFrame:
    """For the suppliers given, an id stays with the cheapest offer of a supplier and is blanked on the others."""
    marked = offers.withColumn("listed", suppliers & F.col("product_id").isNotNull())
    best = marked.filter("listed").groupBy("supplier", "product_id").agg(F.min_by("pos", _price_order()).alias("best"))
    joined = marked.join(best, ["supplier", "product_id"], "left")
    return joined.withColumn("product_id", F.when(~F.col("listed") | (F.col("pos") == F.col("best")), F.col("product_id"))).drop("listed", "best")


def repeated_ids(offers: DataFrame, min_names: int = 2) -> DataFrame:
    """Ids that stand for several names: product_id, n_offers, n_names, min and max price."""
    rows = offers.filter("product_id IS NOT NULL").groupBy("product_id")
    found = rows.agg(F.count("*").alias("n_offers"), F.countDistinct(X.name_key(F.col("product_name"))).alias("n_names"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return found.filter((F.col("n_offers") > 1) & (F.col("n_names") >= min_names))


def repeated_row_count(offers: DataFrame) -> DataFrame:
    counts = offers.filter("product_id IS NOT NULL").groupBy("product_id").count().filter("count > 1")
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"))


def repeated_id_rows(offers: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The rows of ids that stand for several names, less those confirmed by hand (product_id, name_key): with the number of names and the other names."""
    rows = offers.filter("product_id IS NOT NULL").withColumn("name_key", X.name_key(F.col("product_name"))).join(confirmed, ["product_id", "name_key"], "left_anti")
    # Of an id's names only the first six are gathered: five others are shown beside any of them.
    per_name = rows.groupBy("product_id", "name_key").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("product_id").orderBy("name_key")))
    names = per_name.groupBy("product_id").agg(F.count("*").alias("n_names"), F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.when(F.col("k") <= 6, F.col("name_key")))).alias("names")).filter("n_names > 1")
    others = F.array_join(F.slice(F.array_remove("names", F.col("name_key")), 1, 5), "; ")
    return rows.join(names, "product_id").select("product_id", "supplier", "supplier_code", "product_name", F.col("n_names").cast("int").alias("n_names"), "n_rows", others.alias("others"))


def drop_suppliers_of_repeated_ids(offers: DataFrame, suppliers: Column, by: Column) -> DataFrame:
    """Without the offers of the suppliers given whose id goes with two or more values of `by`."""
    many = offers.filter("product_id IS NOT NULL").groupBy("product_id").agg(F.countDistinct(by).alias("n")).filter("n > 1").select("product_id", F.lit(True).alias("many"))
    return with_known(offers, many, "product_id").filter(~(suppliers & F.coalesce("many", F.lit(False)))).drop("many")


def unmatched(offers: DataFrame) -> DataFrame:
    """The offers without an id."""
    return offers.filter("product_id IS NULL")
