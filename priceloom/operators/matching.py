"""Candidates for names: token search, blocked joins, scores and tiers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.operators.matcher import match_names
from priceloom.sources.tables import stored


def search_all(items: DataFrame, words: list[str]) -> DataFrame:
    """Items in whose name every word starts some token."""
    tokens = X.words(F.col("name"), 1)
    for start in map(str.lower, words):
        items = items.filter(F.size(F.filter(tokens, lambda t: F.startswith(t, F.lit(start)))) > 0)  # noqa: B023
    return items


def search_score(name: Column, words: list[str]) -> Column:
    """1000 for the phrase; for each word 80 and its length (20 at most), or 60 and its length where only the compact name holds it; long names lose a little."""
    low, compact = F.lower(name), X.compact_name(name)
    score = F.when(low.contains(" ".join(words).lower()), 1000).otherwise(0)
    for w in map(str.lower, words):
        bare = "".join(c for c in w if c.isalnum())
        score = score + F.when(low.contains(w), 80 + min(len(w), 20)).when(compact.contains(bare) if bare else F.lit(False), 60 + min(len(bare), 20)).otherwise(0)
    return score - F.least(F.length(low), F.lit(250)) / 1000


def search_ranked(items: DataFrame, words: list[str], most: int = 30) -> DataFrame:
    """The items whose names score best for the words, of those that hold some."""
    return items.withColumn("score", F.round(search_score(F.col("name"), words), 3)).filter("score > 0").orderBy(F.desc("score"), "name", "product_id").limit(most)


def search_any(items: DataFrame, words: list[str], most: int = 160) -> DataFrame:
    """product_id, name, hits, rank: the items of which some token begins with a word (words of under three characters: is it), by BM25 with k1 = 1.2, b = 0.75.

    Postings are joined with the few words; frequencies are sums over them, and no item is held against another.
    """
    asked = items.sparkSession.createDataFrame([(w.lower(),) for w in dict.fromkeys(words)], "word string")
    tokens = items.select("product_id", "name", F.explode(F.regexp_extract_all(F.lower("name"), F.lit("([0-9a-zа-яё]+)"))).alias("token"))
    fits = F.when(F.length("word") >= 3, F.col("token").startswith(F.col("word"))).otherwise(F.col("token") == F.col("word"))
    tf = tokens.join(F.broadcast(asked), fits).groupBy("product_id", "name", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    size = F.size(F.regexp_extract_all(F.lower("name"), F.lit("([0-9a-zа-яё]+)")))
    total = items.agg(F.count("*").alias("total"), F.avg(size).alias("mean"))
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * size / F.col("mean")))
    scored = tf.join(F.broadcast(df), "word").join(F.broadcast(total)).groupBy("product_id", "name").agg(F.count("*").alias("hits"), F.round(F.sum(idf * gain), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "product_id").limit(most)


def token_candidates(names: DataFrame, items: DataFrame, shortest: int = 2, most_common: int | None = None) -> DataFrame:
    """product_name, product_id, name, shared, overlap: the pairs that share a token.

    Names are held against the distinct names of items (named_pairs), and the ids are joined back.
    """
    items = items.select("product_id", "name").distinct()
    return named_pairs(names, items, shortest, most_common).join(items, "name").select("product_name", "product_id", "name", "shared", "overlap")


def first_ids(items: DataFrame, most: int) -> DataFrame:
    """product_id, name: of each name of items the `most` smallest ids. Every task leaves out its own others before they meet."""
    place = F.dense_rank().over(Window.partitionBy("name").orderBy("product_id"))
    return items.select("product_id", "name").withColumn("_place", place).filter(F.col("_place") <= most).select("product_id", "name").distinct()


def named_pairs(names: DataFrame, items: DataFrame, shortest: int = 2, most_common: int | None = None) -> DataFrame:
    """product_name, name, shared, overlap: the pairs of distinct names that share a token, whatever ids there are.

    With most_common a name's pairs share a token which at most most_common items have; a name without such a pair gets all
    that share any token with it. Overlap (shared tokens over all tokens of both) is taken over all tokens.
    """
    # Written: names are few beside the offers that give them, and are read several times.
    left = stored(names.select("product_name").distinct()).withColumn("a", X.words(F.col("product_name"), shortest))
    right = items.select("product_id", "name").distinct().groupBy("name").agg(F.count("*").alias("n")).withColumn("b", X.words(F.col("name"), shortest))
    words = left.select("product_name", F.explode("a").alias("token"))
    tokens = right.select("name", "n", F.explode("b").alias("token"))
    if most_common is None:
        pairs = words.join(tokens, "token").select("product_name", "name")
    else:
        rare = tokens.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") <= most_common).select("token")
        pairs = words.join(tokens.join(rare, "token", "left_semi"), "token").select("product_name", "name")
        others = words.join(pairs, "product_name", "left_anti").join(tokens, "token")
        pairs = pairs.union(others.select("product_name", "name"))
    both = pairs.distinct().join(left, "product_name").join(right.drop("n"), "name")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("product_name", "name", shared.alias("shared"), F.round(shared / F.size(F.array_union("a", "b")), 4).alias("overlap"))


def top_candidates(pairs: DataFrame, score: Column, most: int = 5) -> DataFrame:
    best = Window.partitionBy("product_name").orderBy(score.desc(), F.length("product_id"), "product_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


#: Reasons that make a leading candidate a strong one.
STRONG = ("apple_article", "motherboard_model", "numeric_model", "strict_article", "tgpc_code_exact")


def tiers(candidates: DataFrame, score: str = "overlap") -> DataFrame:
    """Per name the best score of its candidates that are not rejected, its lead over the second, and a tier.

    exact: the best has exact set; ambiguous: 0.84 or more with a lead of 0.015 at most; strong: 0.97 or more for a STRONG
    reason, alone or with a lead of 0.02; else possible; none without a candidate. The columns exact, reason and rejected may
    be missing: then none is exact, strong or rejected.
    """
    given = lambda c, kind: F.col(c) if c in candidates.columns else F.lit(None).cast(kind)
    rows = candidates.select("product_name", F.col(score).alias("top"), F.coalesce(given("exact", "boolean"), F.lit(False)).alias("exact"), given("reason", "string").alias("reason"), F.coalesce(given("rejected", "boolean"), F.lit(False)).alias("rejected"), "product_id")
    order = Window.partitionBy("product_name").orderBy("rejected", F.desc("exact"), F.desc("top"), F.length("product_id"), "product_id")
    rows = rows.withColumns({"k": F.row_number().over(order), "second": F.lead("top").over(order), "after": F.lead("rejected").over(order)}).filter("k = 1")
    second = F.when(~F.col("after"), F.col("second"))
    lead = F.round(F.greatest(F.lit(0.0), F.col("top") - F.coalesce(second, F.lit(0.0))), 3)
    strong = (F.col("top") >= 0.97) & F.col("reason").isin(*STRONG) & (second.isNull() | (lead >= 0.02))
    tier = F.when(F.col("rejected"), "none").when(F.col("exact"), "exact").when(second.isNotNull() & (F.col("top") >= 0.84) & (lead <= 0.015), "ambiguous").when(strong, "strong").otherwise("possible")
    active = lambda x: F.when(F.col("rejected"), 0.0).otherwise(x)
    return rows.select("product_name", active(F.col("top")).alias("top"), active(lead).alias("lead"), tier.alias("tier"))


def validate(offers: DataFrame, catalog: DataFrame, least: float = 0.65) -> DataFrame:
    """Distinct (product_id, product_name) of offers held against the catalog's name: decision confirm, clear or missing."""
    pairs = offers.filter("product_id IS NOT NULL").select("product_id", "product_name").distinct().join(catalog.select("product_id", "name"), "product_id", "left")
    known = match_names(pairs.filter("name IS NOT NULL")).withColumn("decision", F.when(F.col("score") >= least, "confirm").otherwise("clear"))
    missing = pairs.filter("name IS NULL").select("product_id", "product_name", "name", F.lit(0.0).alias("score"), F.lit(False).alias("match"), F.lit("no_product").alias("reason"), F.lit("missing").alias("decision"))
    return known.unionByName(missing)
