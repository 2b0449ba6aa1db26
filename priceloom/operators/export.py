"""The export filters, their counts, and the quality checks before an export."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.functions import pricing
from priceloom.functions import text as X
from priceloom.operators.consolidate import drop_suppliers_of_repeated_ids, keep_lowest
from priceloom.sources.tables import discard, stored

NO_CATEGORY = "Без категории"


@dataclass(frozen=True)
class ExportRules:
    deny_category_prefixes: tuple[str, ...] = ()
    allow_categories: tuple[str, ...] = ()
    deny_name_parts: tuple[str, ...] = ()
    include_without_id: bool = True
    keep_lowest: bool = False


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of([F.lower(X.strip(value)).startswith(p.strip().lower()) for p in prefixes if p.strip()])


def contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    return any_of([F.lower(value).contains(p.strip().lower()) for p in parts if p.strip()])


def export_rows(offers: DataFrame, rules: ExportRules) -> DataFrame:
    """Order matters: categories and names first, then ids, then the cheapest offer of each id."""
    rows = offers.filter(~starts_with_any(F.col("category"), rules.deny_category_prefixes))
    if rules.allow_categories:
        rows = rows.filter(F.lower(X.strip(F.col("category"))).isin(*[c.strip().lower() for c in rules.allow_categories]))
    rows = rows.filter(~contains_any(F.col("product_name"), rules.deny_name_parts))
    if not rules.include_without_id:
        rows = rows.filter("product_id IS NOT NULL")
    return keep_lowest(rows) if rules.keep_lowest else rows


#: The options under which the counts of a page are taken; exports have those of ExportRules.
COUNTED = ExportRules(include_without_id=False, keep_lowest=True)


def export_chain(offers: DataFrame, rules: ExportRules, hidden: DataFrame | None = None, effective: Column | None = None, suppliers_once: tuple[str, ...] = (), pc_only: tuple[str, ...] = (), is_pc: Column | None = None) -> DataFrame:
    """All steps of an export in their order: visibility (of the category stored and of the effective one), export_rows, offers of
    the suppliers listed in suppliers_once whose ids stand for several names, then other products than computers of the suppliers in pc_only."""
    rows = offers
    if hidden is not None:
        rows = visible(rows, hidden)
        if effective is not None:
            rows = visible(rows.withColumn("_stored", F.col("category")).withColumn("category", effective), hidden).withColumn("category", F.col("_stored")).drop("_stored")
    rows = export_rows(rows, rules)
    of = lambda names: F.coalesce(F.lower(X.strip(F.col("supplier"))).isin(*[n.strip().lower() for n in names]), F.lit(False))
    if suppliers_once:
        rows = drop_suppliers_of_repeated_ids(rows, of(suppliers_once), X.name_key(F.col("product_name")))
    return only_matching_for(rows, of(pc_only), F.coalesce(is_pc, F.lit(False))) if pc_only else rows


def visible(offers: DataFrame, hidden: DataFrame) -> DataFrame:
    """Without the offers whose category is listed in `hidden` (category), letter case aside."""
    lower = lambda c: F.lower(X.strip(c))
    return offers.join(hidden.select(lower(F.col("category")).alias("gone")).distinct(), lower(F.col("category")) == F.col("gone"), "left_anti")


def only_matching_for(offers: DataFrame, suppliers: Column, test: Column) -> DataFrame:
    """Of the suppliers given only the offers that pass the test; all of the others."""
    return offers.filter(~suppliers | test)


def category_counts(offers: DataFrame) -> DataFrame:
    label = F.when(F.coalesce(X.strip(F.col("category")), F.lit("")) == "", NO_CATEGORY).otherwise(F.col("category"))
    return offers.groupBy(label.alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("product_id").isNull()).alias("n_without_id"))


def export_layout(offers: DataFrame) -> DataFrame:
    """The columns of an export: money with two digits, blanks for nulls."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return offers.select(
        blank("product_id").alias("id"), "product_name", F.round("price", 2).alias("price"), "supplier", blank("warranty").alias("warranty"),
        X.delivery_days(F.col("delivery")).alias("days"), F.round("rrp", 2).alias("rrp"), "category",
    )


def suspicious_prices(offers: DataFrame) -> DataFrame:
    return offers.withColumn("reason", pricing.suspicious(F.col("price"), F.col("rrp"))).filter("reason IS NOT NULL")


def quality_summary(offers: DataFrame) -> DataFrame:
    """One row: offers, missing ids, suspicious prices, and rows that repeat a supplier's name."""
    reason = pricing.suspicious(F.col("price"), F.col("rrp"))
    per_name = offers.groupBy("supplier", X.name_key(F.col("product_name")).alias("key")).agg(
        F.count("*").alias("n"), F.count_if(F.col("product_id").isNull()).alias("missing"), F.count_if(reason.isNotNull()).alias("bad")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_name.agg(total("n").alias("n_offers"), total("missing").alias("n_without_id"), total("bad").alias("n_suspicious"), total(F.when(F.col("n") > 1, F.col("n"))).alias("n_repeated"))


def repeated_names(offers: DataFrame) -> DataFrame:
    rows = offers.groupBy("supplier", X.name_key(F.col("product_name")).alias("name_key"))
    return rows.agg(F.count("*").alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price")).filter("n > 1")


def quality_report(offers: DataFrame) -> DataFrame:
    """issue (missing_id, price, duplicate), detail, and the offer (supplier, category, product_name, price, rrp, pos): a row for each fault of an offer."""
    rows = offers.select("supplier", "category", "product_name", "product_id", "price", "rrp", "pos", X.name_key(F.col("product_name")).alias("key"))
    # How often a supplier's name is there comes from counts, so that no supplier's rows are gathered.
    many = rows.filter("key <> ''").groupBy(F.lower(X.strip(F.col("supplier"))).alias("low"), "key").agg(F.count("*").alias("n")).filter("n > 1")
    own = rows.withColumn("low", F.lower(X.strip(F.col("supplier")))).join(many, ["low", "key"], "left")
    none = F.lit(None).cast("string")
    faults = {"missing_id": F.when(F.col("product_id").isNull(), ""), "price": pricing.suspicious(F.col("price"), F.col("rrp")), "duplicate": F.when(F.col("n") > 1, F.concat(F.lit("x"), F.col("n").cast("string")))}
    listed = F.array(*[F.struct(F.lit(issue).alias("issue"), F.coalesce(detail, none).alias("detail")) for issue, detail in faults.items()])
    each = own.withColumn("fault", F.explode(F.filter(listed, lambda f: f["detail"].isNotNull())))
    return each.select("fault.issue", "fault.detail", "supplier", "category", "product_name", "price", "rrp", "pos")


def quality_samples(report: DataFrame, most: int = 8) -> DataFrame:
    """issue, n and the first `most` offers of each issue in the order of pos, as lines."""
    number = lambda c: F.coalesce(F.round(c, 2).cast("decimal(18,2)").cast("string"), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    shown = {
        "missing_id": F.concat(F.lit("["), blank("category"), F.lit("] "), blank("product_name")),
        "price": F.concat(F.lit("["), blank("category"), F.lit("] "), blank("product_name"), F.lit(" | "), F.col("detail"), F.lit(" | "), number(F.col("price")), F.lit(" / "), number(F.col("rrp"))),
        "duplicate": F.concat(F.lit("["), blank("supplier"), F.lit("] "), blank("product_name"), F.lit(" ("), F.col("detail"), F.lit(")")),
    }
    line = F.coalesce(*[F.when(F.col("issue") == issue, text) for issue, text in shown.items()])
    # Written: the report rests on all offers, and is read once for the counts and once for each issue.
    rows = stored(report.select("issue", "pos", line.alias("line")))
    counts = rows.groupBy("issue").agg(F.count("*").alias("n"))
    # A few of each issue: every task keeps its own first ones only.
    first = None
    for issue in shown:
        own = rows.filter(F.col("issue") == issue).orderBy("pos", "line").limit(most)
        first = own if first is None else first.unionByName(own)
    lines = first.groupBy("issue").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("samples"))
    out = stored(counts.join(lines, "issue"))
    discard(rows)
    return out


def write_quality_report(offers: DataFrame, folder: str) -> None:
    """The report as CSV files with a header in `rows`, and quality_summary as a JSON line in `summary`."""
    report = quality_report(offers)
    report.withColumn("pos", F.to_json("pos") if "struct" in dict(report.dtypes)["pos"] else F.col("pos")).write.mode("overwrite").csv(f"{folder}/rows", header=True)
    quality_summary(offers).write.mode("overwrite").json(f"{folder}/summary")
