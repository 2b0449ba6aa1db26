"""Offers against a reference catalog: lookups, overlays, upserts and checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.operators.similarity import best_overlaps, of_name
from priceloom.sources.tables import stored, with_known


def with_catalog(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Offers with catalog_name and catalog_category of their id."""
    return with_known(offers, catalog.select("product_id", F.col("name").alias("catalog_name"), F.col("category").alias("catalog_category")), "product_id")


def name_index(catalog: DataFrame) -> DataFrame:
    """name_key and the smallest id that has it: one row per key."""
    return catalog.groupBy(X.name_key(F.col("name")).alias("name_key")).agg(F.min(F.struct(F.length("product_id"), "product_id")).alias("m")).select("name_key", F.col("m.product_id").alias("found_id"))


def match_by_name(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Offers without an id whose name key the catalog has, with found_id."""
    rows = offers.filter("product_id IS NULL").withColumn("name_key", X.name_key(F.col("product_name")))
    return rows.join(name_index(catalog), "name_key")


def apply_bindings(offers: DataFrame, bindings: DataFrame) -> DataFrame:
    """Manual decisions (supplier or null for all, name_key, bound_id, blocked): a supplier's own goes first; blocked
    ones clear the id."""
    rows = offers.withColumn("name_key", X.name_key(F.col("product_name")))
    own = bindings.filter("supplier IS NOT NULL").select("supplier", "name_key", F.struct("bound_id", "blocked").alias("own"))
    shared = bindings.filter("supplier IS NULL").select("name_key", F.struct("bound_id", "blocked").alias("shared"))
    rows = rows.join(own, ["supplier", "name_key"], "left").join(shared, "name_key", "left").withColumn("b", F.coalesce("own", "shared"))
    bound = F.when(F.col("b").isNull(), F.col("product_id")).when(~F.col("b.blocked"), F.col("b.bound_id"))
    return rows.withColumn("product_id", bound).drop("own", "shared", "b")


def fan_out(cache: DataFrame) -> DataFrame:
    """How many keys of the cache (key, product_id) an id goes with."""
    return cache.filter("product_id IS NOT NULL").groupBy("product_id").agg(F.countDistinct("key").alias("n_keys"))


def fill_from_cache(offers: DataFrame, cache: DataFrame, most_keys: int = 20) -> DataFrame:
    """Blank ids filled by key from the cache, unless the id goes with too many keys to be trusted."""
    trusted = cache.join(fan_out(cache).filter(F.col("n_keys") <= most_keys), "product_id").select("key", F.col("product_id").alias("cached_id"))
    return offers.join(trusted, "key", "left").withColumn("product_id", F.coalesce("product_id", "cached_id")).drop("cached_id")


def postings(catalog: DataFrame, shortest: int = 4) -> DataFrame:
    """token, product_id."""
    return catalog.select("product_id", F.explode(X.words(F.col("name"), shortest)).alias("token"))


def unique_token_ids(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each name the id of its first token that only one product has: product_name, token, found_id."""
    single = postings(catalog).groupBy("token").agg(F.count("*").alias("n"), F.min("product_id").alias("found_id")).filter("n = 1").drop("n")
    tokens = offers.select("product_name").distinct().select("product_name", F.posexplode(X.words(F.col("product_name"), 4)).alias("place", "token"))
    return tokens.join(single, "token").groupBy("product_name").agg(F.min_by(F.struct("token", "found_id"), "place").alias("m")).select("product_name", "m.*")


def upsert(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog with the changes (product_id, name, category; null keeps the old value); new ids are added."""
    new = changes.select("product_id", F.col("name").alias("new_name"), F.col("category").alias("new_category"))
    return catalog.select("product_id", "name", "category").join(new, "product_id", "full").select(
        "product_id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_category", "category").alias("category")
    )


def check_names(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Offers against the name index: set (no id, name known), correct (another id), ok, or unverified (name unknown)."""
    rows = offers.withColumn("name_key", X.name_key(F.col("product_name"))).join(name_index(catalog), "name_key", "left")
    known = F.col("found_id").isNotNull()
    action = F.when(known & F.col("product_id").isNull(), "set").when(known & (F.col("product_id") != F.col("found_id")), "correct").when(known, "ok").otherwise("unverified")
    return rows.withColumn("action", action)


def upsert_one(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog (product_id, name, url) after single changes: a name that only repeats the id, and a blank url, keep what was there."""
    new = changes.select("product_id", F.when(F.col("name") != F.col("product_id"), F.col("name")).alias("new_name"), F.when(F.col("url") != "", F.col("url")).alias("new_url"))
    joined = catalog.select("product_id", "name", "url").join(new, "product_id", "full")
    return joined.select("product_id", F.coalesce("new_name", "name", "product_id").alias("name"), F.coalesce("new_url", "url").alias("url"))


def insert_ignore(index: DataFrame, new: DataFrame) -> DataFrame:
    """The name index (name_key, product_id) with the new entries whose key it lacks; of new ones with one key the smallest id."""
    fresh = new.filter("name_key <> ''").groupBy("name_key").agg(F.min("product_id").alias("product_id"))
    return index.select("name_key", "product_id").unionByName(fresh.join(index, "name_key", "left_anti").select("name_key", "product_id"))


def from_offers(offers: DataFrame, skipped: Column) -> tuple[DataFrame, DataFrame]:
    """Catalog rows and index rows that offers give: the first name of each id, and the first id of each name key; not of the suppliers skipped."""
    rows = offers.filter(F.col("product_id").isNotNull() & ~F.coalesce(skipped, F.lit(False))).withColumn("name_key", X.name_key(F.col("product_name")))
    items = rows.groupBy("product_id").agg(F.min_by(F.struct("product_name", "category"), "pos").alias("first")).select("product_id", F.col("first.product_name").alias("name"), "first.category")
    index = rows.filter("name_key <> ''").groupBy("name_key").agg(F.min_by("product_id", "pos").alias("product_id"))
    return items, index


def import_rows(catalog: DataFrame, index: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """catalog and index after an import of rows (product_id, name, category), and its counts: inserted, existing, skipped (no id or no name). A row is known by its name and by "category name" too."""
    good = rows.filter("product_id <> '' AND name <> ''")
    last = good.groupBy("product_id").agg(F.max(F.struct("name", "category")).alias("row")).select("product_id", "row.*")
    keys = lambda c: good.select(X.name_key(c).alias("name_key"), "product_id")
    entries = keys(F.col("name")).unionByName(keys(F.concat_ws(" ", "category", "name")))
    known = last.join(catalog.select("product_id", F.lit(True).alias("known")), "product_id", "left")
    counts = known.agg(F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if(F.col("known").isNotNull()).alias("existing"))
    skipped = rows.agg(F.count_if(~F.coalesce((F.col("product_id") != "") & (F.col("name") != ""), F.lit(False))).alias("skipped"))
    return upsert(catalog, last), insert_ignore(index, entries), counts.join(F.broadcast(skipped))


def enforce(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Offers with the ids that the name index gives: blanks are filled, conflicts corrected, ids of unknown names cleared; `action` says which."""
    held = check_names(offers, catalog)
    action = F.when((F.col("action") == "unverified") & F.col("product_id").isNotNull(), "cleared").otherwise(F.col("action"))
    return held.withColumn("action", action).withColumn("product_id", F.col("found_id")).drop("found_id", "name_key")


def overlap_ids(names: DataFrame, catalog: DataFrame, least: float = 0.55) -> DataFrame:
    """product_name, token, found_id: the id of the first token that only one product has; else that of the product with which a name shares the largest part of its tokens, if that is `least` or more (token null)."""
    unique = stored(unique_token_ids(names, catalog))
    rest = names.select("product_name").distinct().join(unique, "product_name", "left_anti")
    # A product of several names has the tokens of all.
    items = catalog.groupBy("product_id").agg(F.concat_ws(" ", F.collect_set("name")).alias("name"))
    best = best_overlaps(rest, items, 1, 4, score=of_name).filter(F.col("overlap") >= least)
    return unique.unionByName(best.select("product_name", F.lit(None).cast("string").alias("token"), F.col("product_id").alias("found_id")))
