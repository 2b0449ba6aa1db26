"""Pages, samples and summaries of a price list."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X

SHORTEST_PAGE, LONGEST_PAGE = 10, 500


def page(rows: DataFrame, order: list[Column], start: int = 0, length: int = 50) -> DataFrame:
    """Rows start to start + length in the given order; the length is held within 10 and 500."""
    return rows.orderBy(*order).offset(max(0, start)).limit(min(LONGEST_PAGE, max(SHORTEST_PAGE, length)))


def search(rows: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows in which some column holds the words, letter case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(words.strip().lower()), F.lit(False))
    return rows.filter(hit)


def by_priority(value: Column, priority: list[str]) -> list[Column]:
    """Sort columns: the listed values first in their order, then the others by letter."""
    place = F.array_position(F.array(*map(F.lit, priority)), value)
    return [F.when(place > 0, place).otherwise(len(priority) + 1), F.lower(value)]


def samples(rows: DataFrame, group: list[str], value: str, most: int = 8) -> DataFrame:
    """Per group its number of rows and the first `most` distinct values by letter, joined by "; "."""
    values = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(value)))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.col(value))))
    return ranked.groupBy(*group).agg(F.sum("n").alias("n"), F.array_join(first, "; ").alias("samples"))


def transitions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """How often each pair of values occurs, and whether it is a change."""
    return rows.groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n")).withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))


def supplier_stats(offers: DataFrame) -> DataFrame:
    """Per supplier, and over all under the name of no supplier: offers, matched, unmatched and the share matched."""
    rows = offers.groupingSets([["supplier"], []], "supplier").agg(F.count("*").alias("total"), F.count("product_id").alias("matched"))
    return rows.select("supplier", "total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), F.round(100.0 * F.col("matched") / F.col("total"), 1).alias("percent"))


def local_category_model(items: DataFrame) -> DataFrame:
    """category, token, tf (names of the category with it), size (names of the category), df (categories with it)."""
    tokens = items.select("category", F.explode(X.words(F.col("name"))).alias("token")).groupBy("category", "token").agg(F.count("*").alias("tf"))
    sizes = items.groupBy("category").agg(F.count("*").alias("size"))
    spread = tokens.groupBy("token").agg(F.count("*").alias("df"))
    return tokens.join(sizes, "category").join(spread, "token").select("category", "token", "tf", "size", "df")


#: Columns of a page in their order, and those of them that sort by number.
PAGE = ("product_id", "product_name", "price", "supplier", "warranty", "days", "rrp", "no_discount", "row_idx", "category")
NUMERIC = ("price", "warranty", "days", "rrp", "no_discount", "row_idx")
NO_CATEGORY = "Без категории"


def in_mode(rows: DataFrame, mode: str = "all", category: str = "", listed: DataFrame | None = None) -> DataFrame:
    """The rows of a page's mode: all, no_id (of a category, if given), duplicate, export (listed: row_idx) or snapshot (listed: product_name)."""
    blank = F.coalesce(X.strip(F.col("product_id")), F.lit("")) == ""
    if mode == "no_id":
        own = F.lower(F.when(F.coalesce(X.strip(F.col("category")), F.lit("")) == "", NO_CATEGORY).otherwise(X.strip(F.col("category"))))
        return rows.filter(blank & (F.lit(not category.strip()) | (own == category.strip().lower())))
    if mode == "duplicate":
        many = rows.filter(~blank).groupBy("product_id").count().filter("count > 1").select("product_id")
        return rows.join(many, "product_id", "left_semi").select(*rows.columns)
    if mode in ("export", "snapshot"):
        key = "row_idx" if mode == "export" else "product_name"
        return rows.join(listed.select(key).distinct(), key, "left_semi").select(*rows.columns)
    return rows


def sort_columns(orders: list[tuple[str, bool]], place: str = "row_idx") -> list[Column]:
    """Sort columns for (column, descending): blanks last upwards and first downwards, words regardless of case, ties by place."""
    out = []
    for name, descending in [o for o in orders if o[0] in PAGE] or [("product_name", False)]:
        value = F.col(name) if name in NUMERIC else F.lower(X.strip(F.col(name)))
        value = value if name in NUMERIC else F.when(value != "", value)
        out.append(value.desc_nulls_first() if descending else value.asc_nulls_last())
    return [*out, F.col(place)]


TIERS = ("exact", "strong", "ambiguous", "possible")


def tier_page(rows: DataFrame, facets: dict[str, str], words: str = "", start: int = 0, length: int = 50) -> DataFrame:
    """The rows (tier, score, product_name and the facets' columns) that meet the facets and whose name holds the words: exact first, then by score and name; total counts them all."""
    for column, value in facets.items():
        rows = rows.filter(F.col(column) == value)
    rows = rows.filter(F.lower("product_name").contains(words.strip().lower()))
    total = rows.agg(F.count("*").alias("total"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(0)), F.lit(len(TIERS) + 1))
    return page(rows, [place, F.desc("score"), F.col("product_name")], start, length).join(F.broadcast(total))


def category_preview(rows: DataFrame, stats: DataFrame, categories: list[str], ids: str = "all", most: int = 10_000) -> DataFrame:
    """Offers of the categories, with or without ids or all, with their market columns, by category and name, `most` at most."""
    kept = rows.filter(F.col("category").isin(*categories))
    kept = {"all": kept, "with_id": kept.filter("product_id IS NOT NULL"), "without_id": kept.filter("product_id IS NULL")}[ids]
    return kept.join(stats, "product_id", "left").orderBy("category", F.lower("product_name"), "pos").limit(most)


def override_items(rows: DataFrame, overrides: DataFrame, words: str, most: int = 50) -> DataFrame:
    """supplier, product_name, category, manual: distinct items whose name holds the words; overrides: name_key, chosen. 1 to 200 of them."""
    items = rows.filter(F.lower("product_name").contains(words.strip().lower())).select("supplier", "product_name", "category").distinct()
    items = items.withColumn("name_key", X.name_key(F.col("product_name"))).join(overrides.select("name_key", "chosen"), "name_key", "left")
    shown = items.select("supplier", "product_name", F.coalesce("chosen", "category").alias("category"), F.col("chosen").isNotNull().alias("manual"))
    return shown.orderBy("product_name", "supplier", "category").limit(min(200, max(1, most)))


def price_tones(rows: DataFrame) -> DataFrame:
    """Rows whose id several rows have, with low or high where they have its least or largest price (low where they are one)."""
    known = rows.filter("product_id IS NOT NULL")
    edges = known.groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most")).filter("n > 1")
    tone = F.when(F.col("price") <= F.col("least"), "low").when(F.col("price") >= F.col("most"), "high").otherwise("middle")
    return known.join(edges, "product_id").withColumn("tone", tone)


def distinct_labels(*sources: DataFrame) -> DataFrame:
    """label: the distinct values of one-column sources that are not blank, in order."""
    rows = sources[0].toDF("label")
    for source in sources[1:]:
        rows = rows.union(source.toDF("label"))
    return rows.select(X.strip(F.col("label")).alias("label")).filter("label <> ''").distinct().orderBy(F.lower("label"), "label")


def option_kind(label: Column, mode: Column, without_id: Column) -> Column:
    """Where a category's option goes: sorting, without_id or market."""
    sorting = label.startswith("Требует сортировки · родитель: ") | (mode == "sorting")
    return F.when(F.coalesce(sorting, F.lit(False)), "sorting").when(F.coalesce((mode == "without_id") | (without_id > 0), F.lit(False)), "without_id").otherwise("market")


def duplicate_meta(rows: DataFrame) -> DataFrame:
    """product_id, n, low, high of the ids that several rows have."""
    return rows.filter("product_id IS NOT NULL").groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high")).filter("n > 1")


def page_counts(rows: DataFrame) -> DataFrame:
    """One row: rows without an id, rows whose id several have, and suppliers (1 at least)."""
    per_id = rows.groupBy("product_id").agg(F.count("*").alias("n"))
    ids = per_id.agg(F.coalesce(F.sum(F.when(F.col("product_id").isNull(), F.col("n"))), F.lit(0)).alias("n_without_id"), F.coalesce(F.sum(F.when(F.col("product_id").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("n_duplicate"))
    return ids.join(F.broadcast(rows.agg(F.greatest(F.lit(1), F.count_distinct("supplier")).alias("n_suppliers"))))


def facets(rows: DataFrame, *columns: Column) -> DataFrame:
    """How many rows each combination of the columns has."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def badges(rows: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """Per supplier its rows without an id, and how many of them fulfil each bucket's test."""
    return rows.filter("product_id IS NULL").groupBy("supplier").agg(F.count("*").alias("n_no_id"), *[F.count_if(t).alias(n) for n, t in buckets.items()])


# The badges of a page, and those of one supplier's products by category; what no badge names is misc.
BADGES = (
    "cpu board monitor gpu ram ssd psu case hdd cooler printer peripheral usb network ups keyboard mouse headphones audio misc "
    "ntech-pc iven-pc iven-laptop iven-zakaz-laptop tradex-laptop"
).split()
BY_CATEGORY = {
    "Процессор": "cpu", "Материнская плата": "board", "Монитор": "monitor", "Видеокарта": "gpu", "Оперативная память": "ram", "SSD": "ssd", "Блок питания": "psu", "Корпус": "case",
    "Жесткий диск": "hdd", "Кулер": "cooler", "Кулеры": "cooler", "Охлаждение": "cooler", "Принтер": "printer", "Принтеры": "printer", "Принтер и МФУ": "printer", "МФУ": "printer", "Картриджи": "printer",
}
IVEN, IVEN_ORDERS, TRADEX, NTECH = ("iven", "ивен"), ("iven_zakaz", "ivenzakaz", "ивен_заказ"), ("tradex", "традекс"), ("n_tech", "ntech")


def badge(supplier: Column, category: Column, is_pc: Column, is_laptop: Column, further: dict[str, str]) -> Column:
    """The badge that counts an offer without an id; null if none does. further: badges of more categories."""
    token = F.regexp_replace(F.regexp_replace(F.lower(X.strip(supplier)), r"[\s-]+", "_"), "^_+|_+$", "")
    known = BY_CATEGORY | further
    by_category = F.coalesce(*[F.when(X.strip(category).isin(*[c for c, b in known.items() if b == badge_]), badge_) for badge_ in dict.fromkeys(known.values()) if badge_ in BADGES], F.lit("misc"))
    return (
        F.when(token.isin(*IVEN) & is_pc, "iven-pc").when(token.isin(*IVEN) & is_laptop, "iven-laptop").when(token.isin(*IVEN_ORDERS) & is_laptop, "iven-zakaz-laptop")
        .when(token.isin(*TRADEX) & is_laptop, "tradex-laptop").when(token.isin(*NTECH), F.when(is_pc, "ntech-pc").otherwise(by_category))
    )


def badge_counts(rows: DataFrame, of: Column) -> DataFrame:
    """badge and n for all BADGES: how many rows without an id each has."""
    found = rows.filter("product_id IS NULL").groupBy(of.alias("badge")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(b,) for b in BADGES], "badge string")
    return every.join(found, "badge", "left").select("badge", F.coalesce("n", F.lit(0)).alias("n"))


def category_preview_counts(rows: DataFrame, old: str, new: str, priced: Column, name: str, most: int = 4) -> DataFrame:
    """new, n, n_changed, n_priced and examples: what each target category would get; examples are the first `most` names that change, by letter."""
    changed = ~F.col(old).eqNullSafe(F.col(new))
    counts = rows.groupBy(new).agg(F.count("*").alias("n"), F.count_if(changed).alias("n_changed"), F.count_if(F.coalesce(priced, F.lit(False))).alias("n_priced"))
    names = rows.filter(changed).select(new, name).distinct().withColumn("k", F.row_number().over(Window.partitionBy(new).orderBy(name))).filter(F.col("k") <= most)
    shown = names.groupBy(new).agg(F.array_join(F.array_sort(F.collect_list(name)), "; ").alias("examples"))
    return counts.join(shown, new, "left").withColumn("examples", F.coalesce("examples", F.lit("")))
