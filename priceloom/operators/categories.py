"""Categories of offers: ordered rules, aliases, precedence, a learnt score, and overrides that spread over shared keys."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.sources.tables import settle


def by_rules(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The category of the first rule (pattern, category) that a name fulfils; else its first word in capitals."""
    first = F.upper(F.get(X.words(name), F.lit(0)))
    return F.coalesce(*[F.when(F.lower(name).rlike(pattern), category) for pattern, category in rules], first)


def under_one_name(category: Column, aliases: dict[str, str]) -> Column:
    """The name that an alias stands for, whatever its case; other categories stay, blanks are null."""
    trimmed = X.strip(category)
    found = F.when(trimmed == "", None)
    for alias, meant in aliases.items():
        found = found.when(F.lower(trimmed) == alias.lower(), meant)
    return found.otherwise(trimmed)


def item_keys(supplier: Column, name: Column) -> Column:
    """The keys under which overrides know an item, the narrow one first."""
    key = X.name_key(name)
    narrow = F.when(X.strip(supplier) != "", F.concat(F.lit("sname:"), X.supplier_token(supplier), F.lit(":"), key))
    return F.when(key != "", F.array_compact(F.array(narrow, F.concat(F.lit("name:"), key))))


def resolve(catalog_category: Column, name_category: Column, override: Column, inferred: Column, current: Column, vague: Column) -> Column:
    """Which of an offer's categories holds: that of its catalog id, of its exact name, the override, the inferred one
    where the current one is vague or missing, then the current one."""
    filled = lambda c: F.when(X.strip(c) != "", c)
    doubtful = filled(current).isNull() | F.coalesce(vague, F.lit(False))
    return F.coalesce(filled(catalog_category), filled(name_category), filled(override), F.when(doubtful, filled(inferred)), filled(current))


def predict(names: DataFrame, model: DataFrame, least_size: int = 2) -> DataFrame:
    """product_name, category, confidence of each distinct name that shares a token with a category of the model.

    The model is (category, token, tf, size, df). A category scores 0.72 of the sum of tf / size * (1 + ln(1 + (1 + N) / (1 + df)))
    over the shared tokens plus 0.28 of the share of the name's tokens; the lead over the second one adds confidence.
    """
    tokens = names.select("product_name").distinct().withColumn("tokens", X.words(F.col("product_name")))
    tokens = tokens.select("product_name", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    n_categories = model.select(F.count_distinct("category")).scalar()
    weighed = model.filter(F.col("size") >= least_size).select("category", "token", (F.col("tf") / F.col("size") * (1 + F.log1p((1 + n_categories) / (1 + F.col("df"))))).alias("weight"))
    score = 0.72 * F.sum("weight") + 0.28 * F.count("*") / F.first("n")
    scored = tokens.join(weighed, "token").groupBy("product_name", "category").agg(F.round(score, 9).alias("score"))
    order = Window.partitionBy("product_name").orderBy(F.desc("score"), "category")
    best = scored.withColumns({"k": F.row_number().over(order), "second": F.coalesce(F.lead("score").over(order), F.lit(0.0))}).filter("k = 1")
    confidence = F.least(F.lit(0.99), F.col("score") / (F.col("score") + 0.8) * 0.82 + F.least(F.lit(0.17), F.col("score") - F.col("second")))
    return best.select("product_name", "category", F.round(confidence, 3).alias("confidence"))


def closure(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """key: the seeds and all that rows (with an array `keys`) tie to them, directly or through other rows.

    Each round follows only the keys that the round before found, and ends where it finds none. Null keys tie nothing.
    """
    links = settle(rows.select(F.array_distinct(F.array_compact("keys")).alias("keys")).distinct())
    single = links.select("keys", F.explode("keys").alias("key"))
    found = fresh = settle(seeds.select("key").filter("key IS NOT NULL").distinct())
    while not fresh.isEmpty():
        reached = single.join(fresh, "key", "left_semi").select(F.explode("keys").alias("key")).distinct()
        fresh = settle(reached.join(found, "key", "left_anti"))
        found = settle(found.unionByName(fresh))
    return found
