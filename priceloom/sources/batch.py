"""A batch of price files as one scan, and tables in versions that a failed batch leaves alone.

All files of a pattern are read at once; a line knows its file and its place, also where a large file is read in parts. Of each
file the first line among HEADER_ROWS that names a product and a price is the header; columns are taken by their headings and
united by name, with nulls where a file lacks one. A file fails if it has no such line, a line that is no text of that form
(another encoding, zero bytes, quotes that don't end), or no row with a name and a positive price. One failed file fails the batch.

A table is a folder of versions. A version counts once Spark has finished it (_SUCCESS), so readers see the last finished one and
never a half-written batch. Empty files fail; a pattern without files is an error.
"""

import re
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.sources import suppliers as U
from priceloom.sources.tables import ALIASES, HEADER_ROWS, discard, stored

FIELDS = ("supplier_code", "product_name", "price", "warranty", "product_id", "rrp")


class BatchError(ValueError):
    """Files that could not be read, with the reason of each."""


@dataclass
class Batch:
    """offers: supplier, FIELDS, file and at (place in the file); report: a row for each file: file, supplier, rows, error (null if it was read)."""

    offers: DataFrame
    report: DataFrame


def scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of the lines (value, path, part, k) and the parts (path, part, begin, nth, file, bad) of all files (read as text).

    A part of a file is known by its place and is the file's nth; k - begin counts its lines from 0; bad counts its lines that are no text of that form.
    """
    clean = F.regexp_replace("value", "^\\uFEFF|\\r$", "").alias("value")
    raw = stored(files.select(clean, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("k")))  # the numbers hold for these parts of the files only
    text = F.col("value")
    bad = text.contains("�") | text.contains("\x00") | ((F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1)
    parts = raw.groupBy("path", "part").agg(F.min("k").alias("begin"), F.count_if(bad).alias("bad"))
    # What a path says is read once a part, not once a line.
    file = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "[+]", "%2B"))
    return raw, stored(parts.select("path", "part", "begin", "bad", F.row_number().over(Window.partitionBy("path").orderBy("part")).cast("long").alias("nth"), file.alias("file")))


def cells_of(value: Column, sep: str, width: int = 40) -> Column:
    """The cells of a line. Without a quote it is only split; the parser, to which a line with another number of cells than `width` is an error to be dealt with, reads the others."""
    cells = F.from_csv(value, ", ".join(f"c{k} string" for k in range(width)), {"sep": sep, "mode": "PERMISSIVE"})
    # Read once: of a field of from_csv() itself Spark makes a reader for each field.
    read = F.transform(F.array(cells), lambda c: F.array(*[c[f"c{k}"] for k in range(width)]))[0]
    return F.when(value.contains('"'), read).otherwise(F.slice(F.split(value, re.escape(sep)), 1, width))


def _plain(path: str) -> str:
    """The path as the lines know it."""
    return re.sub("^file:/+", "file:/", unquote(path))


def headers(lines: DataFrame) -> DataFrame:
    """file, header (its place) and the column number of each field (null if there is none), for files that have a header."""
    low = F.transform("cells", lambda c: F.lower(X.strip(F.coalesce(c, F.lit("")))))
    # The first heading of a field's list that the line has; of several columns the first.
    number = {f: F.coalesce(*[F.nullif(F.array_position("low", F.lit(a)), F.lit(0)) for a in known]) - 1 for f, known in ALIASES.items()}
    likely = lines.filter(F.col("line") < HEADER_ROWS).withColumn("low", low)
    named = likely.select("file", "at", F.struct(*[number[f].cast("int").alias(f) for f in FIELDS]).alias("columns")).filter("columns.product_name IS NOT NULL AND columns.price IS NOT NULL")
    return named.groupBy("file").agg(F.min("at").alias("header"), F.min_by("columns", "at").alias("columns"))


def read_batch(spark: SparkSession, pattern: str, rules: list[tuple[str, str]] = (), sep: str = ",") -> Batch:
    """All files of the pattern. Their suppliers are told by file name and folder, by the rules (part of the name, supplier) first; "Unknown" if nothing tells.

    Rows without a name or a positive price go; of rows of one file with the same code the first stays.
    """
    files = spark.read.text(pattern)
    listed = files.inputFiles()
    lines, parts = scan(files)
    first = lines.join(parts.filter("part = 0").select("path", "part", "begin", "nth", "file"), ["path", "part"]).filter(F.col("k") - F.col("begin") < HEADER_ROWS)
    at = (F.col("k") - F.col("begin") + F.shiftleft("nth", 33)).alias("at")
    supplier = F.coalesce(U.supplier_of_file(F.col("file"), rules), F.lit("Unknown"))
    # What a file's name says is asked once a file, not once a line.
    head = stored(headers(first.select("file", at, (F.col("k") - F.col("begin")).alias("line"), cells_of(F.col("value"), sep).alias("cells"))).withColumn("supplier", supplier))
    known = stored(parts.drop("bad").join(head, "file"))
    columns = F.col("columns")
    cell = lambda f: F.get("cells", columns[f])
    # A blank cell of the parser is null, if it has no quotes.
    value = lambda f: F.when((cell(f) != "") | F.col("quoted"), X.strip(cell(f)))
    kinds = {
        "supplier_code": F.regexp_replace(value("supplier_code"), r"\.0$", ""), "product_name": F.nullif(value("product_name"), F.lit("")), "price": X.money(value("price")),
        "warranty": value("warranty").try_cast("double").cast("int"), "product_id": X.normalize_id(value("product_id")), "rrp": X.money(value("rrp")),
    }
    rows = lines.join(known, ["path", "part"]).select("file", at, "header", "supplier", "columns", F.col("value").contains('"').alias("quoted"), cells_of(F.col("value"), sep).alias("cells")).filter(F.col("at") > F.col("header"))
    rows = stored(rows.select("file", "at", "supplier", *[kinds[f].alias(f) for f in FIELDS]).filter("product_name IS NOT NULL AND price > 0").select("supplier", *FIELDS, "file", "at"))
    # Only the codes that come again are looked up; the rows themselves stay where they are while those are few.
    again = stored(rows.filter("supplier_code <> ''").groupBy("file", "supplier_code").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    used = [lines, parts, head, known, again]
    if not again.isEmpty():
        used.append(rows)
        rows = stored(rows.join(again, ["file", "supplier_code"], "left").filter("first IS NULL OR at = first").select(*rows.columns))
    # Empty files have no lines; they are known from the listing only.
    known = spark.createDataFrame(pa.table({"file": pa.array([_plain(f) for f in listed], pa.string())}))
    bad = parts.groupBy("file").agg(F.sum("bad").alias("bad"))
    report = known.join(bad, "file", "left").join(head.select("file", F.lit(True).alias("headed")), "file", "left").join(rows.groupBy("file").agg(F.count("*").alias("rows")), "file", "left")
    error = F.when(F.col("bad") > 0, "corrupt lines").when(F.col("headed").isNull(), "no header").when(F.col("rows").isNull(), "no rows with a name and a price")
    report = stored(report.select("file", supplier.alias("supplier"), F.coalesce("rows", F.lit(0)).alias("rows"), error.alias("error")))
    discard(*used)
    return Batch(rows, report)


def _folders(spark: SparkSession, table: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v-*")) or ()]
    return sorted((p.getName(), store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))) for p in found)


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The last finished version of a table, None if there is none."""
    done = [name for name, finished in _folders(spark, table) if finished]
    return spark.read.parquet(f"{table}/{done[-1]}") if done else None


def commit(offers: DataFrame, table: str) -> None:
    """Write the rows as the table's next version."""
    spark = offers.sparkSession
    last = max((int(name[2:]) for name, _ in _folders(spark, table)), default=0)
    offers.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{table}/v-{last + 1:09d}")


def load_batch(spark: SparkSession, pattern: str, table: str, rules: list[tuple[str, str]] = (), sep: str = ",") -> DataFrame:
    """Read the files and make their offers the table's next version; returns the report. If any file fails, BatchError says which, and the table stays as it was."""
    batch = read_batch(spark, pattern, rules, sep)
    failed = batch.report.filter("error IS NOT NULL").orderBy("file").limit(5).collect()
    if failed or batch.report.isEmpty():
        discard(batch.offers)
        raise BatchError("; ".join(f"{r.file.rpartition('/')[2]}: {r.error}" for r in failed) or f"no files fulfil {pattern}")
    commit(batch.offers, table)
    discard(batch.offers)
    return batch.report
