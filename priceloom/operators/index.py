"""A kept index of names and the search for any of some words in it, best first, by BM25 with k1 = 1.2 and b = 0.75.

The index is a folder: `postings` (head, token, product_id, tf, size, gain), partitioned by the first characters of the token
and sorted within them by token and falling gain, so that the largest gain of each block of rows is in the files' own
statistics; `items` (product_id, name), and `stats` (one row: how many items, and their mean size). A search reads the
partitions of its words only. From the items with the largest gains of each word comes a score that the last of the best
must reach; an item that reaches it has a large enough share from some word, so blocks whose gains are all smaller are skipped,
and only the items found in the others are scored in full.

A word of three characters and more finds the tokens that begin with it, a shorter one those equal to it. Null names have no
tokens; blank words find nothing. Repeated items count once. An empty index or no words give an empty result.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 2
K1, B = 1.2, 0.75
#: Bytes of a block of rows in the files of the postings.
BLOCK_BYTES = 1 << 20
#: Scores have six digits; whatever is so little below the last of the best counts too.
MARGIN = 2e-6


def _tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("([0-9a-zа-яё]+)"))


def gain(tf: Column, size: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def write_index(items: DataFrame, folder: str) -> None:
    """Index the items (product_id, name)."""
    spark = items.sparkSession
    items.select("product_id", "name").filter("product_id IS NOT NULL AND name IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{folder}/items")
    rows = spark.read.parquet(f"{folder}/items")
    rows.agg(F.count("*").alias("total"), F.avg(F.size(_tokens(F.col("name")))).alias("mean")).write.mode("overwrite").parquet(f"{folder}/stats")
    mean = spark.read.parquet(f"{folder}/stats").first()["mean"] or 1.0
    tokens = rows.select("product_id", "name", F.size(_tokens(F.col("name"))).alias("size"), F.explode(_tokens(F.col("name"))).alias("token"))
    counted = tokens.groupBy("product_id", "name", "size", "token").agg(F.count("*").alias("tf")).withColumn("gain", gain(F.col("tf"), F.col("size"), F.lit(mean)))
    ordered = counted.select(F.substring("token", 1, HEAD).alias("head"), "token", "product_id", "name", "tf", "size", "gain").repartitionByRange("head", "token", F.desc("gain"), "product_id")
    ordered.sortWithinPartitions("head", "token", F.desc("gain")).write.mode("overwrite").option("parquet.block.size", str(BLOCK_BYTES)).partitionBy("head").parquet(f"{folder}/postings")


def lists(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """word and the postings that it finds; of the files only the partitions of the words are read."""
    postings = spark.read.parquet(f"{folder}/postings")

    def found(word: str) -> DataFrame:
        fits = F.col("token").startswith(word) if len(word) >= 3 else F.col("token") == word
        return postings.filter((F.col("head").cast("string") == word[:HEAD]) & fits).select(F.lit(word).alias("word"), "token", "product_id", "name", "tf", "size", "gain")

    return reduce(DataFrame.unionByName, map(found, words))


def _scored(rows: DataFrame, idf: DataFrame, total: int, mean: float) -> DataFrame:
    """product_id, name, hits, score (not rounded) from all postings of some items."""
    per_word = rows.groupBy("product_id", "name", "size", "word").agg(F.sum("tf").alias("tf"))
    share = F.col("idf") * gain(F.col("tf"), F.col("size"), F.lit(mean))
    return per_word.join(F.broadcast(idf), "word").groupBy("product_id", "name").agg(F.count("*").alias("hits"), F.sum(share).alias("score"))  # idf: a row a word


def search(spark: SparkSession, folder: str, words: list[str], most: int = 160) -> DataFrame:
    """product_id, name, hits (words found), score: the `most` best items that have any of the words."""
    words = [w for w in dict.fromkeys(w.strip().lower() for w in words) if w]
    stats = spark.read.parquet(f"{folder}/stats").first()
    if not words or not stats["total"]:
        return spark.read.parquet(f"{folder}/items").limit(0).select("product_id", "name", F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("score"))
    every = lists(spark, folder, words)
    # A row for each word; how many items it finds, and how many of its tokens may add up in an item.
    counts = {r.word: r for r in every.groupBy("word").agg(F.count_distinct("product_id", "name").alias("df"), F.count_distinct("token").alias("tokens")).collect()}
    total, mean = stats["total"], stats["mean"]
    df = spark.createDataFrame([(w, r.df) for w, r in counts.items()], "word string, df long")
    idf = df.select("word", F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = {r.word: r.idf for r in idf.collect()}
    # The items with the largest gains of each word give a score that the best must reach.
    seeds = [every.filter(F.col("word") == w).orderBy(F.desc("gain")).limit(most).select("product_id", "name") for w in counts]
    last = 0.0
    if seeds:
        seen = _scored(every.join(reduce(DataFrame.union, seeds).distinct(), ["product_id", "name"], "left_semi"), idf, total, mean)
        best = [r.score for r in seen.orderBy(F.desc("score")).limit(most).select("score").collect()]
        last = best[-1] - MARGIN if len(best) == most else 0.0
    out = _scored(every.join(candidates(every, counts, weight, last), ["product_id", "name"], "left_semi"), idf, total, mean)
    return out.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "product_id").limit(most)


def candidates(every: DataFrame, counts: dict, weight: dict[str, float], last: float) -> DataFrame:
    """product_id, name of the items of which some posting alone is a large enough share of `last`: one word gives the most, and of that word one token."""
    need = {w: last / (len(counts) * max(weight[w], 1e-12) * r.tokens) for w, r in counts.items()}
    parts = [every.filter((F.col("word") == w) & (F.col("gain") >= n)) for w, n in need.items()]
    if not parts:
        return every.limit(0).select("product_id", "name")
    return reduce(DataFrame.unionByName, parts).select("product_id", "name").distinct()
