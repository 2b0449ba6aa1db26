"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, whose buckets split only when too large.

A bucket is a prefix of a document's 60-bit hash, which is taken of doc_id and text. The directory begins with the empty
prefix; a bucket above the byte limit splits on its next bit, and only such a bucket does. The bytes are summed in cells of
STEP_BITS more bits at a time, so one pass over the cells settles many splits; documents are hashed evenly, so no task
meets a large group. Rows find their bucket in the directory's cell of their first bits: a join with one small table.

A document above the limit gets a shard of its own. Rows that are equal in doc_id and text share a hash, and no bit parts
them: where they exceed the limit together, they are counted by equal rows and dealt to overflow pages, each within the
limit; a group of copies is spread over tasks page by page. Null texts have 0 bytes, a null doc_id hashes like a word of its
own. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.llm.shared import discard, stored, table

LIMIT = 64 << 20
#: The limit of the registered query: small enough that the tables of the tests split.
QUERY_LIMIT = 256 << 10
HASH_BITS = 60
STEP_BITS = 8
#: Rows up to which the directory is sent to every task; a larger one is joined by a shuffle.
SEND_ROWS = 200_000
#: Pages that one task numbers in an overflowing bucket.
PAGES = 64


def hash60(doc_id: Column, text: Column) -> Column:
    word = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5(text), F.lit("-")))
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns given, with bytes and h."""
    return docs.select(*columns, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash60(F.col("doc_id"), F.col("text")).alias("h"))


def _prefix(h: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", h, F.lit(HASH_BITS) - F.lit(bits) if isinstance(bits, int) else F.lit(HASH_BITS) - bits)


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """depth, prefix, shard_bytes, shard_docs: the buckets; prefix has `depth` bits. rows: bytes, h."""
    found, low, active = None, 0, rows.select("h", "bytes")
    while True:
        high = min(HASH_BITS, low + STEP_BITS)
        cells = active.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | ((F.col("depth") == HASH_BITS) & F.lit(high == HASH_BITS))
        sums = stored(sums.withColumn("fits", fits))
        above = sums.filter("not fits").select((F.col("depth") + 1).alias("depth"), "prefix")
        # A bucket is one of the directory if it fits and the bucket that it would be split off does not.
        roots = sums.filter(F.col("fits") & (F.col("depth") == low))
        splits = sums.filter(F.col("fits") & (F.col("depth") > low)).withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        splits = splits.join(above.withColumnRenamed("prefix", "up"), ["depth", "up"], "left_semi")
        kept = roots.unionByName(splits.drop("up")).drop("fits")
        found = kept if found is None else found.unionByName(kept)
        large = sums.filter(~F.col("fits") & (F.col("depth") == high)).select("prefix")
        if high == HASH_BITS or large.isEmpty():
            return found
        active = stored(active.withColumn("prefix", _prefix(F.col("h"), high)).join(large, "prefix", "left_semi").drop("prefix"))
        # Depth `high` was found too large already: the next round begins one bit further.
        low = high + 1


def placed(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """row, bytes, shard, depth, shard_bytes of every row (row: any column or struct; bytes; h)."""
    sizes = stored(rows.select("h", "bytes"))
    buckets = stored(directory(sizes, limit).withColumn("over", (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)))
    discard(sizes)
    n, least, over = buckets.agg(F.count("*"), F.coalesce(F.min("depth"), F.lit(0)), F.coalesce(F.max("over"), F.lit(False))).head()
    cell = F.call_function("shiftright", F.col("prefix"), F.col("depth") - least)
    cells = stored(buckets.groupBy(cell.alias("cell")).agg(F.collect_list(F.struct("depth", "prefix", "shard_bytes", "over")).alias("buckets")))
    met = rows.withColumn("cell", _prefix(F.col("h"), least)).join(F.broadcast(cells) if n <= SEND_ROWS else cells, "cell")
    own = F.get(F.filter("buckets", lambda b: _prefix(F.col("h"), b["depth"]) == b["prefix"]), F.lit(0))
    met = met.withColumn("b", own).select("row", "bytes", "h", "b.*")
    bits = F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0"))
    met = met.withColumn("shard", F.when(F.col("depth") == 0, F.lit("*")).otherwise(bits)).withColumn("depth", F.col("depth").cast("long"))
    columns = ["row", "bytes", "shard", "depth", "shard_bytes"]
    if not over:
        return met.select(*columns)
    return met.filter("not over").select(*columns).unionByName(_paged(met.filter("over"), limit).select(*columns))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of overflowing buckets, in pages within the limit (a row above it is a page)."""
    key = F.to_json(F.struct("row"))
    equal = rows.groupBy("shard", "depth", "bytes", "shard_bytes", key.alias("key")).agg(F.first("row").alias("row"), F.count("*").alias("n"))
    # Equal rows above half the limit have pages of their own, as many rows in each as go in.
    fill = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes")))
    large = equal.filter(F.col("n") * F.col("bytes") * 2 > limit).withColumn("fill", fill)
    large = large.withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("fill")) - 1).cast("long"))))
    large = large.withColumn("here", F.least(F.col("fill"), F.col("n") - F.col("k") * F.col("fill")))
    large = large.withColumns({"page": F.concat_ws("-", F.md5("key"), "k"), "page_bytes": F.col("here") * F.col("bytes")})
    # The others fill pages one after the other, up to half the limit where the last row of a page begins.
    part = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / (PAGES * limit))))
    small = equal.filter(F.col("n") * F.col("bytes") * 2 <= limit).withColumns({"part": part, "here": F.col("n")})
    before = Window.partitionBy("shard", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("k", F.floor(F.coalesce(F.sum(F.col("n") * F.col("bytes")).over(before), F.lit(0)) * 2 / limit))
    small = small.withColumns({"page": F.concat_ws(".", "part", "k"), "page_bytes": F.sum(F.col("n") * F.col("bytes")).over(Window.partitionBy("shard", "part", "k"))})
    columns = ["row", "bytes", "shard", "depth", "page", "page_bytes", "here"]
    pages = large.select(*columns).unionByName(small.select(*columns)).repartition("shard", "page")
    pages = pages.withColumn("shard", F.concat_ws(".", "shard", "page")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("here").cast("long"))))
    return pages.withColumn("shard_bytes", F.col("page_bytes"))


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, shard, depth, shard_bytes of every document; shard: the bits of its bucket, "*" for no bit."""
    return placed(hashed(docs, F.col("doc_id").alias("row")), limit).withColumnRenamed("row", "doc_id")


def shard_rows(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of docs with the columns shard, shard_depth and shard_bytes (those of docs by these names go)."""
    mine = [c for c in docs.columns if c.lower() not in ("shard", "shard_depth", "shard_bytes")]
    rows = placed(hashed(docs, F.struct(*mine).alias("row")), limit)
    return rows.select("row.*", "shard", F.col("depth").alias("shard_depth"), "shard_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), QUERY_LIMIT)


#: Without overflow pages, which only rows that share doc_id and text need.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n
      FROM d, generate_series(0, 60) t(depth) GROUP BY ALL),
own AS (SELECT d.doc_id, d.bytes, d.h, min(b.depth) AS depth
        FROM d, b WHERE b.prefix = d.h >> (60 - b.depth) AND (b.shard_bytes <= {QUERY_LIMIT} OR b.n = 1 OR b.depth = 60)
        GROUP BY ALL)
SELECT doc_id, bytes, CASE WHEN own.depth = 0 THEN '*' ELSE lpad(bin(b.prefix), own.depth::INT, '0') END AS shard,
       own.depth::BIGINT AS depth, shard_bytes
FROM own JOIN b ON b.depth = own.depth AND b.prefix = own.h >> (60 - own.depth)
"""
