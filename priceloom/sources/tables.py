"""Readers: offers from the test tables, raw price files, positional snapshots and nested price payloads."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir.

    Where the setting is missing, a local session gets a temporary folder; a cluster session is refused,
    because its executors could not read a folder of the driver's machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="priceloom-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, so that a lost executor costs a reread. For rows of any kind."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: cuts the lineage as settle does, for an operator's own columns.

    Spark knows the size of such a table, so it packs small files into few tasks and chooses joins by size; both sides of
    a join of two such tables are plain exchanges, of which it splits skewed partitions. discard() frees the disk.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_known(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows with the columns of other, null where it lacks the key. Rows without a key stay where they are: a join would send them all to one task."""
    known = rows.filter(F.col(key).isNotNull()).join(other, key, "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields if f.name != key]
    return known.unionByName(rows.filter(F.col(key).isNull()).select("*", *none))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as supplier offers. pos orders them: the place of a row in its price list."""
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    rows = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return rows.select(
        F.col("s_name").alias("supplier"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("supplier_code"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey").cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("l_extendedprice").alias("price"),
        F.col("p_size").alias("warranty"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.col("l_linenumber").cast("string"), F.lit(" days"))).alias("delivery"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        (F.col("p_retailprice") * 40).alias("rrp"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("pos"),
    )


OFFERS = """offers AS (
  SELECT s_name AS supplier, l_partkey || '-' || l_suppkey AS supplier_code,
         CASE WHEN l_partkey % 7 <> 0 THEN l_partkey::VARCHAR END AS product_id, p_name AS product_name,
         l_extendedprice AS price, p_size AS warranty, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber || ' days' END AS delivery,
         p_type AS category, p_brand AS brand, p_retailprice * 40 AS rrp,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))


CATALOG = "catalog AS (SELECT p_partkey::VARCHAR AS product_id, p_name AS name, p_type AS category, p_brand AS brand FROM part)"

# Headings under which price files give each column.
ALIASES = {
    "supplier_code": ("код", "артикул", "code", "sku"),
    "product_name": ("наименование", "название", "товар", "name", "product"),
    "price": ("цена", "цена с ндс", "price", "price_byn"),
    "warranty": ("гарантия", "warranty"),
    "product_id": ("id", "product_id"),
    "rrp": ("ррц", "мрц", "rrp"),
}
HEADER_ROWS = 20


def read_price_file(spark: SparkSession, path: str, supplier: str, sep: str = ",") -> DataFrame:
    """A CSV price list with any preamble: the first row among HEADER_ROWS that names a product and a price is the header. One
    file only: the lines of several have no common order.

    Rows without a name or a positive price go; the first row of each supplier code wins.
    """
    width = max(len(r) for r in (line.value.split(sep) for line in spark.read.text(path).limit(HEADER_ROWS).collect()))
    names = [f"c{k}" for k in range(width)]
    raw = spark.read.csv(path, sep=sep, schema=", ".join(f"{n} string" for n in names)).withColumn("line", F.monotonically_increasing_id())
    columns: dict[str, str] = {}
    for row in raw.orderBy("line").limit(HEADER_ROWS).collect():
        found = {field: n for field, known in ALIASES.items() for n in reversed(names) if (row[n] or "").strip().lower() in known}
        if {"product_name", "price"} <= found.keys():
            columns, header = found, row.line
            break
    else:
        raise ValueError(f"no header row in {path}")
    field = lambda f: X.strip(F.col(columns[f])) if f in columns else F.lit(None).cast("string")
    rows = raw.filter(F.col("line") > header).select(
        F.lit(supplier).alias("supplier"),
        F.regexp_replace(field("supplier_code"), r"\.0$", "").alias("supplier_code"),
        X.normalize_id(field("product_id")).alias("product_id"),
        F.when(field("product_name") != "", field("product_name")).alias("product_name"),
        X.money(field("price")).alias("price"),
        field("warranty").try_cast("double").cast("int").alias("warranty"),
        X.money(field("rrp")).alias("rrp"),
        F.col("line").alias("pos"),
    )
    rows = rows.filter("product_name IS NOT NULL AND price > 0")
    coded = rows.filter("supplier_code <> ''").groupBy("supplier_code").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "supplier_code"]), "pos").alias("row"))
    return coded.select("row.*", "supplier_code").unionByName(rows.filter("supplier_code IS NULL OR supplier_code = ''"))


# The places of a snapshot row's cells.
SNAPSHOT = ("product_id", "product_name", "price", "supplier", "warranty", "days", "rrp", "no_discount", "row_idx", "category")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows given as arrays of cells: under "data" of one JSON object, or as JSON lines, as write_snapshot writes them; short rows are padded with nulls, blank numbers are null."""
    first = spark.read.text(path).limit(1).collect()
    if first and first[0].value.lstrip().startswith("["):
        rows = spark.read.text(path).select(F.from_json("value", "array<string>").alias("r")).filter("r IS NOT NULL")
    else:
        rows = spark.read.schema("data array<array<string>>").json(path, multiLine=True).select(F.explode("data").alias("r"))
    cell = lambda k: F.get("r", F.lit(k))
    kinds = {"price": "double", "rrp": "double", "no_discount": "double", "row_idx": "int"}
    return rows.select(*[(cell(k).try_cast(kinds[n]) if n in kinds else cell(k)).alias(n) for k, n in enumerate(SNAPSHOT)])


def write_snapshot(offers: DataFrame, path: str) -> None:
    """One array of cells a row, as JSON lines; null, not-a-number and infinite numbers are empty, numbers have two digits."""
    number = lambda c: F.when(F.isnan(c) | c.isNull() | (F.abs(c) == float("inf")), "").otherwise(F.round(c, 2).cast("string"))
    cell = lambda n, kind: number(F.col(n)) if kind == "double" else F.coalesce(F.col(n).cast("string"), F.lit(""))
    kinds = dict(offers.dtypes)
    offers.select(F.to_json(F.array(*[cell(n, kinds[n]) if n in kinds else F.lit("") for n in SNAPSHOT])).alias("value")).write.mode("overwrite").text(path)


PAYLOAD = "positions map<string,array<struct<shop_id:string,position_price:struct<amount:string,converted:struct<BYN:struct<amount:string>>>>>>, shops map<string,struct<title:string>>"


def market_positions(payloads: DataFrame) -> DataFrame:
    """product_id, seller, price from JSON payloads (product_id, payload); the converted amount goes before the plain one."""
    parsed = payloads.select("product_id", F.from_json("payload", PAYLOAD).alias("p")).select("product_id", "p.shops", F.explode("p.positions").alias("key", "rows"))
    # Sellers and numbers are read within the payload: its shops don't go along with each position, and a text is read once and
    # not by the filter too.
    said = lambda r: r["position_price"]
    entry = lambda r: F.struct(F.element_at("shops", r["shop_id"])["title"].alias("seller"), X.number(said(r)["converted"]["BYN"]["amount"]).alias("a"), X.number(said(r)["amount"]).alias("b"))
    rows = parsed.select("product_id", F.explode(F.transform("rows", entry)).alias("r")).select("product_id", "r.seller", "r.a", "r.b")
    price = F.coalesce(X.rounded(F.col("a")), X.rounded(F.col("b")))
    return rows.select("product_id", "seller", price.alias("price")).filter("price > 0").distinct()
