"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target in words. A document's expected copies are target / source size, the same for all
documents of a source, so their prefix sum at the g-th document is g times that. One random offset per source is
added, and a document is emitted once per integer that its step crosses. Documents are ordered by size class, which
keeps the words taken near the target. The order is cut into (source, size class, hash) blocks: a source that holds
a third of all rows is spread over many tasks, and only the block counts are summed up per source.

Null texts have size 0. A null source is a source of its own, the last one. Documents without an id are told apart by their
text. Repeated rows are documents of their own; those that are equal in id, source and text follow one another in the order,
so what each of them gets follows from the place of the first. Reruns agree. An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.llm.shared import ASCII_WORD, row_hash, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SUB_BLOCKS = 256
SEED = "mix-1"


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _mark() -> Column:
    """Names a document by id, source and text; never null."""
    part = lambda c: F.coalesce(F.concat(F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws(" ", part("doc_id"), part("source"), F.xxhash64("text").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and the size of each document in words, with the block it belongs to."""
    size = F.coalesce(F.regexp_count("text", F.lit(ASCII_WORD)), F.lit(0)).cast("long")
    # Texts are only hashed where there is no id.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.coalesce(F.md5("text"), F.lit(""))))
    rows = docs.select("doc_id", "source", size.alias("size"), _hash32(F.concat(F.lit(f"{SEED}:"), name)).alias("h"), _mark().alias("mark"))
    bits = F.length(F.bin("size"))
    return rows.select(
        "doc_id",
        "size",
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("src"),
        (bits * 8 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 3, F.lit(0)))).alias("level"),
        "h",
        "mark",
    ).withColumn("sub", F.col("h") % SUB_BLOCKS)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """src, source_size, target: shares by weight, none above `most` times its source, the excess given to the others.

    One row per source, so the windows over all sources run over a small table. Sources taken by cap / weight
    reach their caps first, so one running sum finds all that do.
    """
    order, every = Window.orderBy("src"), Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "src")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    return (
        sizes.groupBy("src")
        .agg(F.sum("size").alias("source_size"))
        .withColumns({"w": w, "cap": F.col("source_size") * most})
        .withColumn("budget", F.sum("source_size").over(every) * share)
        .withColumns({"left": left, "rest": rest})
        .withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * F.col("left"))
        .withColumn("level_share", (F.col("budget") - taken) / free)
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level_share") * F.col("w")))
        .select("src", "source_size", "target")
    )


def _upto(g: Column) -> Column:
    """How many copies are taken up to the g-th document of a source."""
    return F.floor(F.col("offset") + F.col("step") * g)


def placed(docs: DataFrame, **options) -> DataFrame:
    """Each document with its place g in its source's order, and offset and step of that."""
    rows = stored(sized(docs))
    block = ["src", "level", "sub"]
    before = Window.partitionBy("src").orderBy("level", "sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offset = _hash32(F.concat(F.lit(f"{SEED}/"), F.col("src.none").cast("string"), F.col("src.name"))) / F.lit(4294967296.0)
    blocks = blocks.drop("n").join(targets(rows, **options).withColumn("offset", offset), "src")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("size", "h", "doc_id", "mark"))
    return rows.withColumn("g", rank).join(blocks, block).withColumns({"g": F.col("g") + F.col("before"), "step": step})


def copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and the number of copies that the mix takes of each document."""
    number = _upto(F.col("g")) - _upto(F.col("g") - 1)
    source = F.when(~F.col("src.none"), F.col("src.name"))
    return placed(docs, **options).select("doc_id", source.alias("source"), "size", "source_size", "target", number.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns are those of docs. Texts are shuffled once."""
    first = placed(docs, **options).groupBy("mark").agg(F.min("g").alias("g"), F.first("offset").alias("offset"), F.first("step").alias("step"))
    rows = docs.select(F.struct("*").alias("row"), _mark().alias("mark"), row_hash(docs).alias("h"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("mark").orderBy("h")))
    g = F.col("g") + F.col("nth") - 1
    taken = rows.join(first, "mark").withColumn("copies", (_upto(g) - _upto(g - 1)).cast("int")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


SQL = rf"""
WITH rows AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (source IS NULL) AS none, coalesce(source, '') AS name,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-' || coalesce(md5(text), ''))), 1, 8))::BIGINT AS h
  FROM documents),
lv AS (SELECT *, length(bin(size)) AS bits, h % {SUB_BLOCKS} AS sub FROM rows),
lv2 AS (SELECT *, bits * 8 + (size >> greatest(bits - 3, 0)) AS level FROM lv),
s AS (SELECT none, name, sum(size)::BIGINT AS source_size FROM rows GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY none, name) - 1) % 3 + 1)::INT] AS w, source_size * {MOST} AS cap,
             sum(source_size) OVER () * {SHARE}::DOUBLE AS budget FROM s),
f AS (SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / w, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
             sum(w) OVER (ORDER BY cap / w, none, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
g AS (SELECT *, cap * rest <= w * room AS is_full FROM f),
t AS (SELECT none, name, source_size,
             CASE WHEN is_full THEN cap::DOUBLE
                  ELSE (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () * w END AS target,
             ('0x' || substr(md5('{SEED}/' || none::VARCHAR || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
      FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY none, name ORDER BY level, sub, size, h, doc_id) AS g FROM lv2),
j AS (SELECT r.*, t.source_size, t.target, off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS step
      FROM r JOIN t USING (none, name))
SELECT doc_id, size, source_size, target,
       size * (floor(off + step * g) - floor(off + step * (g - 1)))::BIGINT AS taken,
       (floor(off + step * g) - floor(off + step * (g - 1)))::BIGINT AS copies
FROM j
"""
