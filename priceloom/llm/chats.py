"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation many times: once after every turn. Each turn has the key of the turns so far: their number k
and two 64-bit rolling hashes, to which each turn adds a hash of its content and place by exclusive or. A conversation whose
last key is an earlier key of another one is a snapshot and goes, told by counts of keys. Of equal conversations the one with
the smallest conv_id stays. Texts stay out of all this: turns go as 128-bit hashes, and only the turns of what remains are
gathered, once, and rendered.

No order is needed to add hashes up, so a conversation of more than CHUNK turns is cut by range into chunks that tasks share;
counts and hashes of the chunks before are added. Such a conversation is rendered in parts of CHUNK turns, each a row; all
others are part 0.

Turns are ordered by turn, role and hash of the text, nulls first. Rows of one conversation that are equal in all four
columns count once. Null roles and texts differ from empty ones in the hash and are rendered as empty. A turn without a
conv_id is a conversation of one turn, and loses against any equal one. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.llm.shared import stored, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation from which it is cut into chunks, and turns of a part.
CHUNK = 20_000
#: What a turn is within its conversation.
TURN = ("conv", "turn", "role", "mark")


def _part(value: Column) -> Column:
    """Null and any text map to different strings, and no two sequences of parts to the same one."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def marked(turns: DataFrame) -> DataFrame:
    """The turns with mark, a hash of role and text, and conv, which names the conversation and is never null."""
    mark = F.unhex(F.substring(F.sha2(F.concat(_part(F.col("role")), _part(F.col("text"))), 256), 1, 32))
    alone = F.concat(F.lit("-"), _part(F.col("turn").cast("string")), F.hex("mark"))
    rows = turns.select("conv_id", "turn", "role", "text", mark.alias("mark"))
    return rows.withColumn("conv", F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), alone))


def _chunked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct turns with their chunk; and conv of the conversations that are cut."""
    large = stored(rows.groupBy("conv").count().filter(F.col("count") > CHUNK).select("conv"))  # a row for CHUNK rows at most
    rows = rows.select("conv_id", *TURN).distinct()
    if large.isEmpty():
        return rows.withColumn("chunk", F.lit(0)), large
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.join(F.broadcast(large), "conv", "left_semi").repartitionByRange(parts, *TURN).withColumn("chunk", F.spark_partition_id())
    return rows.join(F.broadcast(large), "conv", "left_anti").withColumn("chunk", F.lit(0)).unionByName(stored(cut)), large


def _grown(rows: DataFrame, values: DataFrame, large: DataFrame, columns: list[str], fold, add) -> DataFrame:
    """rows with the columns increased by what fold makes of them (in values) over the chunks before."""
    if large.isEmpty():
        return rows
    totals = values.join(F.broadcast(large), "conv", "left_semi").groupBy("conv", "chunk").agg(*[fold(c).alias(c) for c in columns])
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "chunk", *[F.coalesce(fold(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns])
    joined = rows.join(F.broadcast(totals), ["conv", "chunk"], "left")
    return joined.withColumns({c: add(F.col(c), F.coalesce(f"{c}_before", F.lit(0))) for c in columns}).select(*rows.columns)


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, the columns of TURN, k (the place of the turn), a and b: with k, the key of the turns so far; and the conversations that were cut."""
    rows, large = _chunked(rows)
    within = Window.partitionBy("conv", "chunk")
    rows = rows.withColumn("k", F.row_number().over(within.orderBy("turn", "role", "mark")).cast("long"))
    if not large.isEmpty():
        rows = stored(_grown(rows, rows.withColumn("k", F.lit(1)), large, ["k"], F.sum, lambda x, y: x + y))
    hashed = rows.withColumns({"a": F.xxhash64("k", "mark"), "b": F.xxhash64("mark", F.lit("b"), "k")})
    so_far = within.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.withColumns({c: F.bit_xor(c).over(so_far) for c in ("a", "b")})
    summed = _grown(summed, hashed, large, ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    return stored(summed.select("conv_id", *TURN, "k", "a", "b")), large


def _rendered(rows: DataFrame, kept: DataFrame, *order: str) -> DataFrame:
    """One text for each conversation and part of rows (conv, part, role, text and the order)."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(F.lit(OPEN), blank(F.col("role")), F.lit("\n"), blank(F.col("text")), F.lit(f"{CLOSE}\n"))
    lines = F.array_sort(F.collect_set(F.struct(*[F.struct(F.col(c).isNotNull().alias("some"), c).alias(c) for c in order], line.alias("line"))))
    gathered = rows.groupBy("conv", "part").agg(lines.alias("lines"))
    return gathered.join(kept, "conv").select("conv_id", "part", "n_turns", "n_copies", F.array_join("lines.line", "").alias("text"))


def chat_texts(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: the rendered conversations that no longer one begins with, and how many equal ones each stands for."""
    texts, key = marked(turns), ["k", "a", "b"]
    rows, large = placed(texts.drop("text"))
    sizes = rows.groupBy("conv", "conv_id").agg(F.max(F.struct(*key)).alias("last"))
    # Equal conversations meet as one row per task before they are shuffled.
    best = sizes.groupBy("last.k", "last.a", "last.b").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "conv")).alias("best"), F.count("*").alias("n_copies"))
    # A key that more turns have than conversations end with is within some conversation.
    every = rows.groupBy(*key).agg(F.count("*").alias("n_seen"))
    kept = best.join(every, key).filter("n_seen = n_copies").select("best.conv", "best.conv_id", F.col("k").alias("n_turns"), "n_copies")
    kept = stored(kept)
    shown = texts.join(kept.select("conv"), "conv", "left_semi")
    short = shown if large.isEmpty() else shown.join(F.broadcast(large), "conv", "left_anti")
    out = _rendered(short.withColumn("part", F.lit(0).cast("long")), kept, "turn", "role", "mark")
    if large.isEmpty():
        return out
    # Every turn of a long conversation finds its place by itself, so no task meets the whole of it.
    place = rows.join(F.broadcast(large), "conv", "left_semi").select(*[F.col(c).alias(f"own_{c}") for c in TURN], "k")
    met = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in TURN]
    long = shown.join(F.broadcast(large), "conv", "left_semi").join(place, met).withColumn("part", F.floor((F.col("k") - 1) / CHUNK))
    return out.unionByName(_rendered(long, kept, "k"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_texts(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text, sha256(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-')) AS mark FROM conversations),
c AS (SELECT *, coalesce(':' || conv_id, '-' || coalesce(turn::VARCHAR, '') || mark) AS conv FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role NULLS FIRST, mark) AS k, count(*) OVER (PARTITION BY conv) AS n FROM c),
p AS (SELECT conv, conv_id, k, n, string_agg(mark, ',') OVER (PARTITION BY conv ORDER BY k) AS so_far FROM o),
whole AS (SELECT so_far, arg_min(conv, (conv_id IS NULL, conv_id, conv)) AS conv, count(*) AS n_copies FROM p WHERE k = n GROUP BY so_far),
kept AS (SELECT * FROM whole WHERE so_far NOT IN (SELECT so_far FROM p WHERE k < n))
SELECT any_value(conv_id) AS conv_id, 0::BIGINT AS part, count(*)::BIGINT AS n_turns, any_value(n_copies)::BIGINT AS n_copies,
       string_agg('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), '' ORDER BY k) AS text
FROM kept JOIN o USING (conv) GROUP BY conv
"""
