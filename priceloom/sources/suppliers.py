"""Supplier price lists by position, by newest file, without a header, and as JSON."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X


@dataclass(frozen=True)
class Layout:
    """Where a supplier's files have what: `files` is a pattern of names, `columns` names columns by their number, rows up to
    `header` are skipped, and only rows with the values of `only` count."""

    files: str
    columns: dict[int, str]
    header: int = 0
    only: dict[str, str] = field(default_factory=dict)


# The layouts of the known suppliers.
_ORDERED = {0: "supplier_code", 1: "product_name", 2: "quantity", 3: "price", 4: "warranty", 5: "product_id", 6: "catalog_name"}
LAYOUTS = {
    "BN-1030Z": Layout("1030ZpriceBN*", {0: "supplier_code", 1: "product_name", 3: "price", 4: "warranty", 5: "product_id", 6: "catalog_name"}, 8),
    "BN-1030": Layout("1030priceBN*", _ORDERED, 8),
    "BN-1374": Layout("1374priceBN*", _ORDERED, 8),
    "Tradex": Layout("Tradex*", {0: "supplier_code", 1: "product_name", 2: "price", 4: "quantity", 6: "status", 9: "article", 10: "warranty", 13: "catalog_name", 14: "product_id"}, 0, {"status": "В наличии"}),
    "TGPC": Layout("price_bn_*", {0: "supplier_code", 2: "product_name", 3: "warranty", 6: "price"}),
}


def newest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The last path by letter that fulfils the pattern; any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(s.getPath()) for s in found or ()), default=None)


def positioned(rows: DataFrame, layout: Layout, supplier: str) -> DataFrame:
    """Offers from rows of cells (cells array<string>, line): without the header's echo, blank codes and prices that are not positive; the first row of each code stays."""
    cell = lambda k: X.strip(F.get("cells", F.lit(k)))
    named = rows.filter(F.col("line") > layout.header).select("line", *[cell(k).alias(n) for k, n in layout.columns.items()])
    for column, value in layout.only.items():
        named = named.filter(F.col(column) == value)
    code = F.regexp_replace("supplier_code", r"\.0$", "")
    named = named.withColumns({"supplier_code": code, "price": X.money(F.col("price"))}).filter("supplier_code <> '' AND price > 0")
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("supplier_code").orderBy("line"))).filter("nth = 1").drop("nth")
    ids = {"product_id": X.normalize_id(F.col("product_id"))} if "product_id" in named.columns else {}
    return first.withColumns(ids | {"supplier": F.lit(supplier), "warranty": F.col("warranty").try_cast("double").cast("int")})


def read_cells(spark: SparkSession, path: str, sep: str = ",", width: int = 20) -> DataFrame:
    """cells and line of one delimited file; lines count from 0. One file only: the lines of several have no common order."""
    rows = spark.read.csv(path, sep=sep, schema=", ".join(f"c{k} string" for k in range(width)))
    return rows.select(F.array(*rows.columns).alias("cells"), F.monotonically_increasing_id().alias("line"))


def guessed_columns(cells: DataFrame, width: int, sample: int = 200) -> dict[str, int]:
    """The columns of a list without a header, judged by its first rows: the price is the one with most numbers between 1 and
    100,000, the name the one with the longest texts that are no numbers, the code the first other one that is always filled."""
    rows = cells.orderBy("line").limit(sample)
    value = lambda k: X.strip(F.get("cells", F.lit(k)))
    number = lambda k: X.money(value(k))
    priced = [F.count_if((number(k) > 1) & (number(k) < 100_000)) for k in range(width)]
    length = [F.coalesce(F.avg(F.when(number(k).isNull(), F.length(value(k)))), F.lit(0.0)) for k in range(width)]
    filled = [F.count_if(value(k) != "") for k in range(width)]
    head = rows.agg(F.count("*").alias("n"), F.array(*priced).alias("priced"), F.array(*length).alias("length"), F.array(*filled).alias("filled")).head()
    name = max(range(width), key=lambda k: head["length"][k])
    # Of columns with as many prices the last one: codes come first.
    price = max((k for k in range(width) if k != name), key=lambda k: (head["priced"][k], k))
    code = next((k for k in range(width) if k not in (name, price) and head["filled"][k] >= head["priced"][price] > 0), None)
    return {"product_name": name, "price": price} | ({"supplier_code": code} if code is not None else {})


def unheadered(cells: DataFrame, supplier: str, width: int) -> DataFrame:
    """Offers of a list without a header: supplier, supplier_code, product_name, price, line; rows without a name or a positive price go."""
    at = guessed_columns(cells, width)
    value = lambda c: X.strip(F.get("cells", F.lit(at[c]))) if c in at else F.lit(None).cast("string")
    rows = cells.select(F.lit(supplier).alias("supplier"), value("supplier_code").alias("supplier_code"), value("product_name").alias("product_name"), X.money(value("price")).alias("price"), "line")
    return rows.filter("product_name <> '' AND price > 0")


PRODUCTS = "array<struct<id:string,name:string,category:string,`group`:string,warranty:string,price:string,price_with_vat:string,recommended_price:string,retail_price:string>>"


def products(payloads: DataFrame) -> DataFrame:
    """source, place, id, name, category, warranty, price, price_with_vat, retail: the products of JSON payloads (source, payload) in their order."""
    rows = payloads.select("source", F.posexplode(F.from_json(F.get_json_object("payload", "$.products"), PRODUCTS)).alias("place", "p"))
    return rows.select("source", "place", "p.id", "p.name", F.coalesce(F.nullif(X.strip(F.col("p.category")), F.lit("")), X.strip(F.col("p.group"))).alias("category"), "p.warranty", "p.price", "p.price_with_vat", F.coalesce("p.recommended_price", "p.retail_price").alias("retail"))


def sectioned(rows: DataFrame) -> DataFrame:
    """source, place, is_section, label: the rows of a list with a heading before each change of category (blank ones change nothing)."""
    order = Window.partitionBy("source").orderBy("place")
    filled = F.nullif(F.col("category"), F.lit(""))
    before = F.last(filled, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("begins", filled.isNotNull() & ~filled.eqNullSafe(before))
    parts = F.when(F.col("begins"), F.array(F.struct(F.lit(True).alias("is_section"), F.col("category").alias("label")), F.struct(F.lit(False).alias("is_section"), F.col("name").alias("label"))))
    parts = parts.otherwise(F.array(F.struct(F.lit(False).alias("is_section"), F.col("name").alias("label"))))
    return marked.select("source", "place", F.inline(parts))


def renamed(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Columns whose names were read in the wrong encoding (UTF-8 taken for windows-1251) get the names given that they stand for."""
    broken = {n.encode().decode("cp1251", "replace"): n for n in names}
    return rows.withColumnsRenamed({c: broken[c] for c in rows.columns if c in broken})


def by_file_name(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The supplier of the first rule (part of the name, supplier) that the file name fulfils."""
    return F.coalesce(*[F.when(F.lower(name).contains(part.lower()), supplier) for part, supplier in rules], F.lit(None).cast("string"))


# What a file's name and folder say of its supplier, first that fits; and how suppliers that rules name are spelled.
FILE_RULES = (
    ("n-?_?tech", "N-Tech"), ("iven[-_ ]*zakaz", "IVEN_zakaz"), ("iven", "IVEN"), ("tradex", "Tradex"), ("1030z", "BN-1030Z"), ("1030", "BN-1030"), ("1374", "BN-1374"), ("price_bn", "TGPC"),
)
SPELLINGS = {"ntech": "N-Tech", "ivenzakaz": "IVEN_zakaz", "iven": "IVEN"}


def supplier_of_file(path: Column, rules: list[tuple[str, str]] = ()) -> Column:
    """The supplier that a path's last two parts (folder and file) tell: by the caller's rules (part of the name, supplier), then by FILE_RULES; null if nothing tells."""
    name = F.lower(F.regexp_extract(path, "([^/]*/?[^/]+)$", 1))
    spelled = lambda s: SPELLINGS.get(s.lower().replace("-", "").replace("_", "").replace(" ", ""), s)
    given = [F.when(name.contains(part.strip().lower()), spelled(supplier.strip())) for part, supplier in rules if part.strip() and supplier.strip()]
    return F.coalesce(*given, *[F.when(name.rlike(pattern), supplier) for pattern, supplier in FILE_RULES], F.lit(None).cast("string"))
