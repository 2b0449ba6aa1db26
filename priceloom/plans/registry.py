"""All queries over the price-list tables, by name, and the SQL that each agrees with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions import models as D
from priceloom.functions import pricing
from priceloom.functions import payloads as Y
from priceloom.functions import text as X
from priceloom.operators import catalog as C
from priceloom.operators import categories as G
from priceloom.operators import consolidate as K
from priceloom.operators import export as E
from priceloom.operators import journal as J
from priceloom.operators import market as M
from priceloom.operators import matcher
from priceloom.operators import matching as N
from priceloom.operators import paging as P
from priceloom.operators import review as R
from priceloom.operators import similarity as Q
from priceloom.operators import snapshots as S
from priceloom.sources.tables import CATALOG, OFFERS, catalog, market_positions, offers, stored, table
from priceloom.streaming import events as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CORE = ["supplier", "supplier_code", "product_id", "product_name", "price", "category"]
_CORE = ", ".join(CORE)
def _listed():
    """The suppliers that the queries name."""
    return F.col("supplier") < "Supplier#000000005"


_KEY = "trim(regexp_replace(regexp_replace(lower(product_name), '^\\s*\\[[^\\]]*\\]', ''), '\\s+', ' ', 'g'))"


def query(sql: str | None = None, name: str = ""):
    """Registers a function of (offers) or (spark, sf_dir) with the SQL of its result; OFFERS and CATALOG come before it."""

    def register(f):
        key = name or f.__name__
        takes_offers = f.__code__.co_argcount == 1
        QUERIES[key] = (lambda spark, sf_dir: f(offers(spark, sf_dir))) if takes_offers else f
        if sql:
            SQL[key] = f"WITH {OFFERS}, {CATALOG}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register


# Consolidation

@query(f"SELECT {_CORE} FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, pos) AS k FROM offers) WHERE k = 1 OR product_id IS NULL")
def consolidate_keep_lowest(rows):
    return K.keep_lowest(rows).select(*CORE)


@query("""SELECT product_id, supplier, 'code:' || supplier_code AS row_key, arg_min(product_name, (price, pos)) AS product_name, min(price) AS price, arg_min(rrp, (price, pos)) AS rrp,
  arg_min(category, (price, pos)) AS category, max(warranty) AS warranty, coalesce(regexp_extract(arg_min(delivery, pos) FILTER (delivery IS NOT NULL), '[0-9]+'), '2') AS delivery_days
  FROM offers GROUP BY product_id, supplier, supplier_code""")
def consolidate_simple(rows):
    return K.consolidate(rows)


_FIVE = [f"Supplier#00000000{k}" for k in range(5)]


@query("SELECT product_id, min_by(product_name, pos) AS product_name, " + ", ".join(f"min(price) FILTER (supplier = '{s}') AS price_{k}" for k, s in enumerate(_FIVE, 1)) + """, min(price) AS min_price,
  arg_min(supplier, (price, pos)) AS best_supplier, max(warranty) AS warranty FROM offers WHERE product_id IS NOT NULL GROUP BY product_id""")
def consolidate_pivot(rows):
    return K.price_matrix(rows, _FIVE)


@query("SELECT DISTINCT supplier, 'code:' || supplier_code AS row_key FROM offers")
def row_keys(rows):
    return rows.select("supplier", K.row_key().alias("row_key")).distinct()


@query(f"SELECT {_CORE} FROM offers WHERE product_id IS NULL")
def unmatched_offers(rows):
    return K.unmatched(rows).select(*CORE)


#: Ids that stand for several products: the names of the tables have one id each.
_SHARED, _SHARED_SQL = "cast(pos.l_partkey % 13 AS string)", "(split_part(supplier_code, '-', 1)::BIGINT % 13)::VARCHAR"


@query(f"SELECT {_SHARED_SQL} AS product_id, count(*) AS n_offers, count(DISTINCT {_KEY}) AS n_names, min(price) AS min_price, max(price) AS max_price FROM offers GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT {_KEY}) > 1")
def dup_id_issues(rows):
    return K.repeated_ids(rows.withColumn("product_id", F.expr(_SHARED)))


@query(f"""SELECT supplier, supplier_code, {_KEY} AS name, id AS product_id, n_names, n_rows FROM (SELECT *, {_SHARED_SQL} AS id FROM offers) JOIN (SELECT {_SHARED_SQL} AS id, count(DISTINCT {_KEY}) AS n_names, count(*) AS n_rows FROM offers
  WHERE NOT contains(lower(product_name), 'widget') GROUP BY 1 HAVING count(DISTINCT {_KEY}) > 1) USING (id) WHERE NOT contains(lower(product_name), 'widget')""")
def dup_id_rows(rows):
    rows = rows.withColumn("product_id", F.expr(_SHARED))
    confirmed = rows.filter(F.lower("product_name").contains("widget")).select("product_id", X.name_key(F.col("product_name")).alias("name_key")).distinct()
    return K.repeated_id_rows(rows, confirmed).select("supplier", "supplier_code", X.name_key(F.col("product_name")).alias("name"), "product_id", "n_names", "n_rows")


@query("SELECT coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM offers WHERE product_id IS NOT NULL GROUP BY product_id) WHERE n > 1")
def dup_id_row_count(rows):
    return K.repeated_row_count(rows)


@query("""SELECT supplier, supplier_code, CASE WHEN supplier >= 'Supplier#000000005' OR k = 1 THEN product_id END AS product_id, price
  FROM (SELECT *, row_number() OVER (PARTITION BY supplier, product_id ORDER BY price, pos) AS k FROM offers)""")
def clear_dup_ids_within_supplier(rows):
    return K.clear_repeated_ids(rows, _listed()).select("supplier", "supplier_code", "product_id", "price")


@query(f"""SELECT supplier, supplier_code, product_name, price FROM (SELECT *, (split_part(supplier_code, '-', 1)::BIGINT % 997)::VARCHAR AS id FROM offers) LEFT JOIN (SELECT (split_part(supplier_code, '-', 1)::BIGINT % 997)::VARCHAR AS id, count(DISTINCT {_KEY}) AS many FROM offers GROUP BY 1) USING (id)
  WHERE NOT (supplier < 'Supplier#000000005' AND many > 1)""")
def drop_dup_suppliers(rows):
    rows = rows.withColumn("product_id", (F.col("pos.l_partkey") % 997).cast("string"))
    return K.drop_suppliers_of_repeated_ids(rows, _listed(), X.name_key(F.col("product_name"))).select("supplier", "supplier_code", "product_name", "price")


# Export

@query(f"""SELECT {_CORE} FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, pos) AS k FROM offers
  WHERE NOT lower(category) LIKE 'promo%' AND NOT contains(lower(product_name), 'bolt') AND product_id IS NOT NULL) WHERE k = 1""")
def export_pipeline(rows):
    return E.export_rows(rows, E.ExportRules(("Promo",), (), ("BOLT",), False, True)).select(*CORE)


@query("SELECT category, count(*) AS n, count(*) FILTER (product_id IS NULL) AS n_without_id FROM offers WHERE lower(category) IN ('economy', 'large') GROUP BY category")
def export_counts_by_category(rows):
    return E.category_counts(E.export_rows(rows, E.ExportRules(allow_categories=("economy", "LARGE "))))


@query("SELECT coalesce(product_id, '') AS id, product_name, round(price, 2) AS price, supplier, coalesce(warranty::VARCHAR, '') AS warranty, coalesce(regexp_extract(delivery, '[0-9]+'), '2') AS days, round(rrp, 2) AS rrp, category FROM offers")
def export_layout(rows):
    return E.export_layout(rows)


_REASON = "CASE WHEN price IS NULL OR price <= 0 THEN 'invalid_price' WHEN rrp IS NULL OR rrp <= 0 THEN 'invalid_rrp' WHEN rrp <= price THEN 'rrp_not_above_price' WHEN rrp - price < 20 AND rrp - price < price * 0.05 THEN 'low_margin' END"


@query(f"SELECT supplier, supplier_code, price, rrp, {_REASON} AS reason FROM offers WHERE {_REASON} IS NOT NULL")
def suspicious_price(rows):
    return E.suspicious_prices(rows).select("supplier", "supplier_code", "price", "rrp", "reason")


@query(f"""SELECT sum(n)::BIGINT AS n_offers, sum(missing)::BIGINT AS n_without_id, sum(bad)::BIGINT AS n_suspicious, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_repeated
  FROM (SELECT count(*) AS n, count(*) FILTER (product_id IS NULL) AS missing, count({_REASON}) AS bad FROM offers GROUP BY supplier, {_KEY})""")
def quality_summary(rows):
    return E.quality_summary(rows)


@query(f"SELECT supplier, {_KEY} AS name_key, count(*) AS n, min(price) AS min_price, max(price) AS max_price FROM offers GROUP BY ALL HAVING count(*) > 1")
def preexport_duplicates(rows):
    return E.repeated_names(rows)


@query(f"SELECT {_CORE} FROM offers WHERE lower(category) NOT IN ('promo', 'small')")
def visibility_anti(rows):
    hidden = rows.sparkSession.createDataFrame([("PROMO",), ("small ",)], "category string")
    return E.visible(rows, hidden).select(*CORE)


@query(f"SELECT {_CORE} FROM offers WHERE supplier >= 'Supplier#000000005' OR contains(lower(product_name), 'widget')")
def pc_only_filter(rows):
    return E.only_matching_for(rows, _listed(), E.contains_any(F.col("product_name"), ("widget",))).select(*CORE)


# Market and prices

@query("""SELECT product_id, round(any_value(low), 2) AS min_price, floor((2 * any_value(cents) + count(*)) / (2.0::DOUBLE * count(*))) / 100 AS avg_price, round(any_value(high), 2) AS max_price, count(*) AS offers,
  count(*) FILTER (price <= low * 1.02) AS min_competitors, count(*) FILTER (abs(price - mean) <= greatest(1, mean * 0.05)) AS avg_competitors
  FROM (SELECT product_id, price, min(price) OVER w AS low, sum(round(price * 100)) OVER w AS cents, sum(round(price * 100)) OVER w / count(*) OVER w / 100 AS mean, max(price) OVER w AS high FROM offers WHERE product_id IS NOT NULL WINDOW w AS (PARTITION BY product_id)) GROUP BY product_id""")
def market_stats(rows):
    return M.market_stats(rows.filter("product_id IS NOT NULL").select("product_id", "price"))


@query("""SELECT o.supplier, o.supplier_code, o.product_id, o.price, m.low AS min_price, m.n AS offers FROM offers o
  LEFT JOIN (SELECT product_id, round(min(price), 2) AS low, count(*) AS n FROM offers WHERE product_id IS NOT NULL GROUP BY product_id) m USING (product_id)""")
def market_enrich(rows):
    return M.enrich(rows, M.market_stats(rows.filter("product_id IS NOT NULL").select("product_id", "price"))).select("supplier", "supplier_code", "product_id", "price", "min_price", "offers")


# The rules of the markup queries.
RULES = [("ECONOMY", 10.0, 5000.0, 300.0, 5.0, "wholesale"), ("PROMO", 7.5, 0.0, 0.0, 0.0, "market_min"), ("LARGE", 20.0, 20000.0, 900.0, 10.0, "market_max")]
_TENS = "CASE WHEN {0} > 0 THEN floor((floor({0}) + 5) / 10) * 10 ELSE 0.0 END"


def _markups(sql_base: str, extra: str = "") -> str:
    values = ", ".join(str(r) for r in RULES)
    return f""", rules(category, percent, threshold, min_profit, no_discount_percent, base_mode) AS (SELECT * FROM (VALUES {values})),
m AS (SELECT product_id, round(min(price), 2) AS min_price, round(max(price), 2) AS max_price FROM offers WHERE product_id IS NOT NULL GROUP BY product_id),
b AS (SELECT o.*, r.* EXCLUDE (category), {sql_base} AS base FROM offers o JOIN rules r USING (category) LEFT JOIN m USING (product_id)),
p AS (SELECT *, CASE WHEN base <= threshold THEN greatest(base * (1 + percent / 100), base + min_profit) ELSE base * (1 + percent / 100) END AS marked FROM b),
q AS (SELECT *, {_TENS.format('marked')} AS retail FROM p)
SELECT supplier, supplier_code, price, base, retail, {_TENS.format('retail * (1 + no_discount_percent / 100)')} AS no_discount FROM q {extra}"""


def _apply(rows, **options):
    config = rows.sparkSession.createDataFrame(RULES, "category string, percent double, threshold double, min_profit double, no_discount_percent double, base_mode string")
    stats = M.market_stats(rows.filter("product_id IS NOT NULL").select("product_id", "price"))
    return M.apply_markups(M.enrich(rows, stats), config, **options).select("supplier", "supplier_code", "price", "base", "retail", "no_discount")


_BASE = "CASE base_mode WHEN 'wholesale' THEN price WHEN 'market_min' THEN min_price WHEN 'market_max' THEN max_price END"


@query(_markups(f"coalesce({_BASE}, price)"))
def markup_apply(rows):
    return _apply(rows)


@query(_markups(_BASE, "WHERE base IS NOT NULL"))
def markup_market_base(rows):
    return _apply(rows, missing_market="skip")


@query(f"SELECT DISTINCT price, {_TENS.format('price')} AS rounded FROM offers")
def round_price_tens(rows):
    return rows.select("price", pricing.round_to_tens(F.col("price")).alias("rounded")).distinct()


@query("""SELECT product_id, string_agg(price::DECIMAL(18,2)::VARCHAR || ' ' || supplier, '; ' ORDER BY price, supplier) AS near FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, supplier) AS k FROM (SELECT *, min(price) OVER (PARTITION BY product_id) AS low FROM offers WHERE product_id IS NOT NULL) WHERE price <= low * 1.02) WHERE k <= 8 GROUP BY product_id""")
def near_min_offers(rows):
    found = M.nearest_offers(rows.filter("product_id IS NOT NULL").select("product_id", "price", "supplier"))
    shown = F.transform("near", lambda x: F.concat_ws(" ", x["price"].cast("decimal(18,2)").cast("string"), x["supplier"]))
    return found.select("product_id", F.array_join(shown, "; ").alias("near"))


# Pages and summaries

@query("SELECT supplier, supplier_code, product_name, price FROM offers ORDER BY price DESC, pos LIMIT 50 OFFSET 100")
def page_sorted(rows):
    return P.page(rows, [F.desc("price"), F.col("pos")], 100, 50).select("supplier", "supplier_code", "product_name", "price")


@query(f"SELECT {_CORE} FROM offers WHERE contains(lower(product_name), 'gear') OR contains(lower(supplier), 'gear') OR contains(lower(category), 'gear')")
def page_search(rows):
    return P.search(rows, " Gear ", ["product_name", "supplier", "category"]).select(*CORE)


@query("SELECT product_id, count(*) AS n, min(price) AS low, max(price) AS high FROM offers WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) > 1")
def page_meta(rows):
    return P.duplicate_meta(rows)


@query("SELECT category, lower(product_name) AS name, count(*) AS n FROM offers WHERE product_id IS NULL GROUP BY ALL")
def priority_sort(rows):
    grouped = rows.filter("product_id IS NULL").groupBy("category", F.lower("product_name").alias("name")).agg(F.count("*").alias("n"))
    return grouped.orderBy(*P.by_priority(F.col("category"), ["PROMO", "LARGE"]), "name")


@query("SELECT category, count(*) AS n, count(*) FILTER (product_id IS NULL) AS n_without_id FROM offers GROUP BY category")
def categories_summary(rows):
    return E.category_counts(rows)


@query("""SELECT supplier, category, sum(n)::BIGINT AS n, string_agg(product_name, '; ' ORDER BY product_name) FILTER (k <= 8) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY supplier, category ORDER BY product_name) AS k FROM (SELECT supplier, category, product_name, count(*) AS n FROM offers GROUP BY ALL)) GROUP BY supplier, category""")
def supplier_category_samples(rows):
    return P.samples(rows, ["supplier", "category"], "product_name")


@query("SELECT category AS old, brand AS new, count(*) AS n, category <> brand AS changed FROM offers GROUP BY ALL")
def transition_matrix(rows):
    return P.transitions(rows, "category", "brand")


@query("SELECT supplier, count(*) AS total, count(product_id) AS matched, count(*) - count(product_id) AS unmatched, round(100.0::DOUBLE * count(product_id) / count(*), 1) AS percent FROM offers GROUP BY GROUPING SETS ((supplier), ())")
def supplier_stats_rollup(rows):
    return P.supplier_stats(rows)


@query("SELECT category, brand, product_id IS NULL AS no_id, count(*) AS n FROM offers GROUP BY ALL")
def facet_counts(rows):
    return P.facets(rows, F.col("category"), F.col("brand"), F.col("product_id").isNull().alias("no_id"))


@query("""SELECT supplier, count(*) AS n_no_id, count(*) FILTER (contains(lower(product_name), 'widget')) AS n_widget, count(*) FILTER (category = 'PROMO') AS n_promo, count(*) FILTER (price > 50000) AS n_dear
  FROM offers WHERE product_id IS NULL GROUP BY supplier""")
def badge_counts(rows):
    buckets = {"n_widget": E.contains_any(F.col("product_name"), ("widget",)), "n_promo": F.col("category") == "PROMO", "n_dear": F.col("price") > 50000}
    return P.badges(rows, buckets)


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[0-9a-zа-яё]+'), lambda t: length(t) >= {1}))"


@query(f""", t AS (SELECT category, unnest({_TOKENS.format('name', 2)}) AS token FROM catalog), c AS (SELECT category, token, count(*) AS tf FROM t GROUP BY ALL)
SELECT category, token, tf, size, count(*) OVER (PARTITION BY token) AS df FROM c JOIN (SELECT category, count(*) AS size FROM catalog GROUP BY category) USING (category)""")
def local_category_model(spark, sf_dir):
    return P.local_category_model(catalog(spark, sf_dir))


# Snapshots

_SNAP = """SELECT supplier, coalesce('id:' || product_id, 'name:' || lower(product_name)) AS key, arg_max(product_name, pos) AS product_name, arg_max(price, pos) AS price FROM offers"""
_CUT = "1998-01-01"


@query(f"{_SNAP} GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def snapshot_build(rows):
    return S.build(rows)


@query(f""", a AS ({_SNAP} WHERE l_shipdate < '{_CUT}' GROUP BY 1, 2), b AS ({_SNAP} WHERE l_shipdate >= '{_CUT}' GROUP BY 1, 2)
SELECT * FROM (SELECT supplier, key, a.price AS old_price, b.price AS new_price,
  CASE WHEN a.price IS NULL THEN 'new' WHEN b.price IS NULL THEN 'removed' WHEN abs(a.price - b.price) >= 0.01 THEN 'changed' END AS status FROM a FULL JOIN b USING (supplier, key)) WHERE status IS NOT NULL""")
def snapshot_diff(rows):
    shipped = F.col("pos.l_shipdate")
    return S.diff(S.build(rows.filter(shipped < F.lit(_CUT).cast("timestamp"))), S.build(rows.filter(shipped >= F.lit(_CUT).cast("timestamp"))))


def _sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("supplier"), F.col("event_id").alias("session"), F.col("ts").alias("updated_at"))


@query("SELECT supplier, session, k AS rank FROM (SELECT event_type AS supplier, event_id AS session, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id)::INT AS k FROM events) WHERE k <= 5")
def snapshot_keep_latest(spark, sf_dir):
    return S.latest_sessions(_sessions(spark, sf_dir)).select("supplier", "session", "rank")


@query("""SELECT event_id, value, before, CASE WHEN abs(value - before) < 0.0001 THEN 'same' WHEN value > before THEN 'up' WHEN value < before THEN 'down' END AS trend
  FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def price_trend(spark, sf_dir):
    return S.trend(table(spark, sf_dir, "events"), "user_id", "ts,event_id", "value").select("event_id", "value", "before", "trend")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def section_breaks(spark, sf_dir):
    return S.section_breaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


# Texts

@query(f"""SELECT DISTINCT product_name, {_KEY} AS name_key, regexp_replace(lower(product_name), '[^0-9a-zа-яё]+', '', 'g') AS compact, array_to_string(list_sort(list_filter({_TOKENS.format('product_name', 3)}, lambda t: t NOT IN ('black', 'white', 'blue', 'red', 'green', 'grey', 'gray', 'silver', 'gold', 'orange', 'pink', 'purple', 'box', 'oem', 'ret', 'rtl'))), ' ') AS tokens, lower(replace(supplier, ' ', '_')) AS token FROM offers""")
def name_forms(rows):
    name = F.col("product_name")
    return rows.select(name, X.name_key(name).alias("name_key"), X.compact_name(name).alias("compact"), F.array_join(F.array_sort(D.name_tokens(name)), " ").alias("tokens"), X.supplier_token(F.col("supplier")).alias("token")).distinct()


@query(""", t AS (SELECT event_id, event_type || ' SSD ' || (event_id % 7) || '.0 TB / ' || event_type || ' ' || event_id || 'gb' AS s FROM events)
SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(s), '[0-9]+(?:\\.[0-9]+)? ?(?:tb|gb)'), lambda t: regexp_replace(replace(t, ' ', ''), '\\.0+([a-z])', '\\1')))), ' ') AS sizes FROM t""")
def capacity_tokens(spark, sf_dir):
    name = F.concat("event_type", F.lit(" SSD "), (F.col("event_id") % 7).cast("string"), F.lit(".0 TB / "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("gb"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.capacity_tokens(name), " ").alias("sizes"))


@query("""SELECT DISTINCT supplier, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(supplier || ' ' || brand), '[0-9A-Z][0-9A-Z#-]+'), lambda t: length(t) >= 8 AND regexp_matches(t, '[0-9]')))), ' ') AS articles FROM offers""")
def article_tokens(rows):
    return rows.select("supplier", F.array_join(F.array_sort(X.article_tokens(F.concat_ws(" ", "supplier", "brand"))), " ").alias("articles")).distinct()


@query("""SELECT DISTINCT price, round(price, 2) AS amount, CASE WHEN product_id IS NULL THEN NULL ELSE product_id END AS id FROM offers""")
def money_and_ids(rows):
    written = F.regexp_replace(F.concat(F.lit(" "), F.format_string("%.2f", "price"), F.lit(" ")), r"\.", ",")
    return rows.select("price", X.money(written).alias("amount"), X.normalize_id(F.concat(F.coalesce("product_id", F.lit("nan")), F.when(F.col("product_id").isNotNull(), ".0").otherwise(""))).alias("id")).distinct()


# Catalog

@query("SELECT o.supplier, o.supplier_code, o.product_id, c.name AS catalog_name, c.category AS catalog_category FROM offers o LEFT JOIN catalog c USING (product_id)")
def catalog_join(spark, sf_dir):
    return C.with_catalog(offers(spark, sf_dir), catalog(spark, sf_dir)).select("supplier", "supplier_code", "product_id", "catalog_name", "catalog_category")


_INDEX = ", ix AS (SELECT lower(name) AS name_key, min_by(product_id, product_id::BIGINT) AS found_id FROM catalog GROUP BY 1)"


@query(f"{_INDEX} SELECT supplier, supplier_code, name_key, found_id FROM offers JOIN ix ON lower(product_name) = name_key WHERE product_id IS NULL")
def exact_name_join(spark, sf_dir):
    return C.match_by_name(offers(spark, sf_dir), catalog(spark, sf_dir)).select("supplier", "supplier_code", "name_key", "found_id")


@query("""SELECT supplier, supplier_code, CASE WHEN supplier = 'Supplier#000000001' AND product_name = 'small widget' THEN 'bound-1' WHEN product_name = 'small widget' THEN NULL WHEN product_name = 'large bolt' THEN 'bound-2' ELSE product_id END AS product_id FROM offers""")
def manual_binding_overlay(rows):
    bindings = [("Supplier#000000001", "small widget", "bound-1", False), (None, "small widget", None, True), (None, "large bolt", "bound-2", False)]
    decided = rows.sparkSession.createDataFrame(bindings, "supplier string, name_key string, bound_id string, blocked boolean")
    return C.apply_bindings(rows, decided).select("supplier", "supplier_code", "product_id")


@query("SELECT product_id, count(DISTINCT supplier) AS n_keys FROM offers WHERE product_id IS NOT NULL GROUP BY product_id")
def id_fanout(rows):
    return C.fan_out(rows.select(F.col("supplier").alias("key"), "product_id"))


@query("""SELECT o.supplier, o.supplier_code, coalesce(o.product_id, c.product_id) AS product_id FROM offers o LEFT JOIN catalog c
  ON o.supplier_code = c.product_id || '-1' AND c.product_id::BIGINT % 2 = 1""")
def id_cache_overlay(spark, sf_dir):
    cache = catalog(spark, sf_dir).filter(F.col("product_id").cast("long") % 2 == 1).select(F.concat("product_id", F.lit("-1")).alias("key"), "product_id")
    return C.fill_from_cache(offers(spark, sf_dir).withColumn("key", F.col("supplier_code")), cache).select("supplier", "supplier_code", "product_id")


@query(f""", p AS (SELECT s_name || ' ' || s_nationkey AS name, s_suppkey::VARCHAR AS id FROM supplier), t AS (SELECT id, unnest({_TOKENS.format('name', 4)}) AS token FROM p),
u AS (SELECT token, min(id) AS found_id FROM t GROUP BY token HAVING count(*) = 1)
SELECT DISTINCT supplier AS product_name, token, found_id FROM offers JOIN u ON list_contains({_TOKENS.format('supplier', 4)}, token)""")
def unique_token_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("product_id"), F.concat_ws(" ", "s_name", "s_nationkey").alias("name"))
    return C.unique_token_ids(offers(spark, sf_dir).select(F.col("supplier").alias("product_name")), items)


@query("""SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(b.name, a.name) AS name, coalesce(b.category, a.category) AS category FROM catalog a
  FULL JOIN (SELECT (product_id::BIGINT + 50)::VARCHAR AS product_id, 'new ' || name AS name, NULL::VARCHAR AS category FROM catalog WHERE product_id::BIGINT % 3 = 0) b ON a.product_id = b.product_id""")
def upsert_catalog(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    n = F.col("product_id").cast("long")
    return C.upsert(rows, rows.filter(n % 3 == 0).select((n + 50).cast("string").alias("product_id"), F.concat(F.lit("new "), "name").alias("name"), F.lit(None).cast("string").alias("category")))


@query(f"""{_INDEX} SELECT CASE WHEN found_id IS NULL THEN 'unverified' WHEN product_id IS NULL THEN 'set' WHEN product_id <> found_id THEN 'correct' ELSE 'ok' END AS action, count(*) AS n
  FROM offers LEFT JOIN ix ON lower(product_name) = name_key GROUP BY 1""")
def catalog_consistency(spark, sf_dir):
    return C.check_names(offers(spark, sf_dir), catalog(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


# Search and matching

@query("SELECT product_id, name FROM catalog WHERE regexp_matches(lower(name), '(^|[^0-9a-z])wid') AND regexp_matches(lower(name), '(^|[^0-9a-z])sm')")
def fts_and(spark, sf_dir):
    return N.search_all(catalog(spark, sf_dir), ["wid", "Sm"]).select("product_id", "name")


@query("""SELECT product_id, name, round(CASE WHEN contains(lower(name), 'small widget') THEN 1000 ELSE 0 END + CASE WHEN contains(lower(name), 'small') THEN 85 ELSE 0 END + CASE WHEN contains(lower(name), 'widget') THEN 86 ELSE 0 END
  - least(length(name), 250) / 1000.0::DOUBLE, 3) AS score FROM catalog WHERE score > 0 ORDER BY score DESC, name, product_id LIMIT 30""")
def search_ranked(spark, sf_dir):
    return N.search_ranked(catalog(spark, sf_dir), ["small", "widget"]).select("product_id", "name", "score")


_NAMES = "s AS (SELECT s_suppkey::VARCHAR AS product_id, s_name || ' ' || s_nationkey AS name FROM supplier)"
_PAIRS = f""", {_NAMES}, a AS (SELECT DISTINCT supplier AS product_name, {_TOKENS.format('supplier', 2)} AS a FROM offers), b AS (SELECT *, {_TOKENS.format('name', 2)} AS b FROM s),
tk AS (SELECT product_id, unnest(b) AS token FROM b), rare AS (SELECT token FROM tk GROUP BY token HAVING count(*) <= 5),
pr AS (SELECT DISTINCT product_name, product_id FROM (SELECT product_name, unnest(a) AS token FROM a) JOIN tk USING (token) JOIN rare USING (token)),
pairs AS (SELECT product_name, product_id, name, len(list_intersect(a, b))::INT AS shared, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 4) AS overlap FROM pr JOIN a USING (product_name) JOIN b USING (product_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY overlap DESC, length(product_id), product_id)::INT AS rank FROM pairs)"""


def _pairs(spark, sf_dir):
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("product_id"), F.concat_ws(" ", "s_name", "s_nationkey").alias("name"))
    return N.token_candidates(offers(spark, sf_dir).select(F.col("supplier").alias("product_name")), items, most_common=5)


def _tiers(pairs):
    exact = F.lower("name") == F.lower("product_name")
    return N.tiers(N.top_candidates(pairs, F.col("overlap")).withColumn("exact", exact & (F.col("rank") == 1)))


@query(f"{_PAIRS} SELECT * FROM pairs")
def token_block_candidates(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"{_PAIRS} SELECT product_name, product_id, overlap, rank FROM top WHERE rank <= 5")
def top_n_candidates(spark, sf_dir):
    return N.top_candidates(_pairs(spark, sf_dir), F.col("overlap")).select("product_name", "product_id", "overlap", "rank")


@query(f"""{_PAIRS}, g AS (SELECT product_name, max(overlap) AS top, max(overlap) FILTER (rank = 2) AS second, bool_or(rank = 1 AND lower(name) = lower(product_name)) AS exact FROM top WHERE rank <= 5 GROUP BY 1),
h AS (SELECT product_name, top, second, exact, round(greatest(0, top - coalesce(second, 0)), 3) AS lead FROM g)
SELECT product_name, top, lead, CASE WHEN exact THEN 'exact' WHEN second IS NOT NULL AND top >= 0.84 AND lead <= 0.015 THEN 'ambiguous' ELSE 'possible' END AS tier FROM h""")
def candidate_tiers(spark, sf_dir):
    return _tiers(_pairs(spark, sf_dir))


_WHOLE = f""", a AS (SELECT DISTINCT product_name, {_TOKENS.format('product_name', 2)} AS a FROM offers), b AS (SELECT product_id, name, {_TOKENS.format('name', 2)} AS b FROM catalog),
pairs AS (SELECT product_name, product_id, name, len(list_intersect(a, b))::INT AS shared, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 4) AS overlap FROM a, b WHERE list_has_any(a, b)),
top AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY overlap DESC, length(product_id), product_id)::INT AS rank FROM pairs)"""


def _catalog_pairs(spark, sf_dir):
    return N.token_candidates(offers(spark, sf_dir), catalog(spark, sf_dir))


@query(f"{_WHOLE} SELECT * FROM pairs")
def catalog_candidates(spark, sf_dir):
    return _catalog_pairs(spark, sf_dir)


@query(f"{_WHOLE} SELECT product_name, product_id, overlap, rank FROM top WHERE rank <= 5")
def catalog_top_candidates(spark, sf_dir):
    return Q.best_overlaps(offers(spark, sf_dir), catalog(spark, sf_dir)).select("product_name", "product_id", "overlap", "rank")


@query(f"""{_WHOLE}, g AS (SELECT product_name, max(overlap) AS top, max(overlap) FILTER (rank = 2) AS second, bool_or(rank = 1 AND lower(name) = lower(product_name)) AS exact FROM top WHERE rank <= 5 GROUP BY 1),
h AS (SELECT product_name, top, second, exact, round(greatest(0, top - coalesce(second, 0)), 3) AS lead FROM g)
SELECT product_name, top, lead, CASE WHEN exact THEN 'exact' WHEN second IS NOT NULL AND top >= 0.84 AND lead <= 0.015 THEN 'ambiguous' ELSE 'possible' END AS tier FROM h""")
def catalog_candidate_tiers(spark, sf_dir):
    return _tiers(Q.best_overlaps(offers(spark, sf_dir), catalog(spark, sf_dir)))


@query()
def validate_ids(spark, sf_dir):
    return N.validate(offers(spark, sf_dir), catalog(spark, sf_dir))


@query()
def match_scores(spark, sf_dir):
    items = catalog(spark, sf_dir).select("product_id", "name").distinct()
    pairs = N.named_pairs(offers(spark, sf_dir), items).select("product_name", "name")
    # Written, so that Spark sends the scores of names to the items and not the items to every task.
    scored = stored(matcher.match_names(pairs))
    return scored.join(items, "name").select("product_name", "product_id", "name", "score", "match", "reason")


# Categories and review work

_RULES = [(r"\b(bolt|rod|ring)\b", "Fasteners"), (r"\b(large|small) ", "Sized"), (r"^(old|new) ", "Aged")]
_INFERRED = "CASE WHEN regexp_matches(lower(product_name), '\\b(bolt|rod|ring)\\b') THEN 'Fasteners' WHEN regexp_matches(lower(product_name), '\\b(large|small) ') THEN 'Sized' WHEN regexp_matches(lower(product_name), '^(old|new) ') THEN 'Aged' ELSE upper(string_split(product_name, ' ')[1]) END"


@query(f"SELECT product_name, {_INFERRED} AS category, count(*) AS n FROM offers GROUP BY ALL")
def category_infer(rows):
    return rows.groupBy("product_name", G.by_rules(F.col("product_name"), _RULES).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT category, CASE lower(category) WHEN 'economy' THEN 'Budget' WHEN 'promo' THEN 'Budget' ELSE category END AS known_as, count(*) AS n FROM offers GROUP BY ALL")
def category_alias_map(rows):
    return rows.groupBy("category", G.under_one_name(F.col("category"), {"Economy": "Budget", "Promo": "Budget"}).alias("known_as")).agg(F.count("*").alias("n"))


@query(f"""SELECT supplier, category, {_INFERRED} AS inferred, coalesce(CASE WHEN product_id IS NOT NULL AND category <> 'PROMO' THEN category END, CASE WHEN supplier = 'Supplier#000000001' THEN 'Chosen' END,
  CASE WHEN category = 'PROMO' THEN {_INFERRED} END, category) AS holds, count(*) AS n FROM offers GROUP BY ALL""")
def category_precedence(rows):
    listed = F.when(F.col("product_id").isNotNull() & (F.col("category") != "PROMO"), F.col("category"))
    chosen = F.when(F.col("supplier") == "Supplier#000000001", "Chosen")
    inferred = G.by_rules(F.col("product_name"), _RULES)
    holds = G.resolve(listed, F.lit(None).cast("string"), chosen, inferred, F.col("category"), F.col("category") == "PROMO")
    return rows.groupBy("supplier", "category", inferred.alias("inferred"), holds.alias("holds")).agg(F.count("*").alias("n"))


@query(f""", t AS (SELECT category, unnest({_TOKENS.format('name', 2)}) AS token FROM catalog), c AS (SELECT category, token, count(*) AS tf FROM t GROUP BY ALL),
m AS (SELECT category, token, tf, size, count(*) OVER (PARTITION BY token) AS df, (SELECT count(DISTINCT category) FROM c) AS total FROM c JOIN (SELECT category, count(*) AS size FROM catalog GROUP BY category) USING (category)),
d AS (SELECT DISTINCT product_name, {_TOKENS.format('product_name', 2)} AS words FROM offers), u AS (SELECT product_name, len(words) AS n, unnest(words) AS token FROM d),
s AS (SELECT product_name, category, round(0.72 * sum(tf / size * (1 + ln(1 + (1 + total) / (1 + df)))) + 0.28 * count(*) / any_value(n), 9) AS score FROM u JOIN m USING (token) WHERE size >= 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY product_name ORDER BY score DESC, category))
SELECT product_name, category, round(least(0.99, score / (score + 0.8) * 0.82 + least(0.17, score - second)), 3) AS confidence FROM r WHERE k = 1""")
def category_predict(spark, sf_dir):
    return G.predict(offers(spark, sf_dir), P.local_category_model(catalog(spark, sf_dir)))


@query(f""", k AS (SELECT DISTINCT 'sname:' || lower(supplier) || ':' || lower(product_name) AS a, 'name:' || lower(product_name) AS b FROM offers),
f AS (SELECT DISTINCT a AS key FROM k WHERE a LIKE 'sname:supplier#000000001:blue%'), n AS (SELECT DISTINCT b AS key FROM k JOIN f ON a = f.key)
SELECT key FROM n UNION SELECT a FROM k JOIN n ON b = n.key""")
def override_closure(spark, sf_dir):
    keys = offers(spark, sf_dir).select(G.item_keys(F.col("supplier"), F.col("product_name")).alias("keys"))
    return G.closure(keys, keys.select(F.get("keys", F.lit(0)).alias("key")).filter("key LIKE 'sname:supplier#000000001:blue%'"))


@query("""SELECT name_key, q.supplier, added FROM (SELECT lower(product_name) AS name_key, supplier, max(l_shipdate)::DATE AS added FROM offers WHERE product_id IS NULL GROUP BY ALL) q
  JOIN (SELECT lower(product_name) AS name_key, supplier, arg_max(coalesce(product_id, ''), pos) AS last_id FROM offers GROUP BY ALL) o USING (name_key, supplier) WHERE last_id = ''""")
def review_queue_list(rows):
    queue = rows.filter("product_id IS NULL").groupBy(X.name_key(F.col("product_name")).alias("name_key"), "supplier").agg(F.max(F.col("pos.l_shipdate").cast("date")).alias("added"))
    return R.open_entries(queue, rows).select("name_key", "supplier", "added")


@query()
def replacement_candidates(spark, sf_dir):
    items = catalog(spark, sf_dir)
    return R.replacements(N.named_pairs(offers(spark, sf_dir), items).select("product_name", "name", F.col("overlap").alias("score")), items=items)


_PARTS = R.Family(r"(anvil|bolt|gear|gizmo|plate|ring|rod|widget)$", {"part": r"\b([a-z]+)$"}, {"size": (r"\b(large|small)\b", 0.03, 0.12), "colour": (r"\b(blue|red)\b", 0.01, 0.05)})


@query(""", p AS (SELECT DISTINCT product_name FROM offers), i AS (SELECT DISTINCT product_id, name FROM catalog),
e AS (SELECT product_name, product_id, CASE WHEN product_name = name THEN 1.0 ELSE least(0.999, 0.9
  + CASE WHEN product_name[1:5] IN ('large', 'small') AND name[1:5] IN ('large', 'small') THEN CASE WHEN product_name[1:5] = name[1:5] THEN 0.03 ELSE -0.12 END ELSE 0 END
  + CASE WHEN string_split(product_name, ' ')[1] IN ('red', 'blue') AND string_split(name, ' ')[1] IN ('red', 'blue') THEN CASE WHEN string_split(product_name, ' ')[1] = string_split(name, ' ')[1] THEN 0.01 ELSE -0.05 END ELSE 0 END) END AS s
  FROM p JOIN i ON string_split(product_name, ' ')[2] = string_split(name, ' ')[2]),
r AS (SELECT product_name, product_id, round(s::DOUBLE, 3) AS score, row_number() OVER (PARTITION BY product_name ORDER BY s DESC, length(product_id), product_id)::INT AS rank FROM e)
SELECT * FROM r WHERE rank <= 5""")
def family_candidates(spark, sf_dir):
    return R.family_candidates(offers(spark, sf_dir), catalog(spark, sf_dir), _PARTS)


# Journal

@query(f"SELECT supplier, supplier_code, CASE WHEN contains(lower(product_name), 'bolt') THEN NULL ELSE product_id END AS product_id FROM offers")
def bulk_clear(rows):
    return J.clear_ids(rows, E.contains_any(F.col("product_name"), ("bolt",)))[0].select("supplier", "supplier_code", "product_id")


@query("SELECT supplier, supplier_code, product_name, CASE WHEN contains(lower(product_name), 'bolt') AND supplier >= 'Supplier#000000003' THEN NULL ELSE product_id END AS product_id FROM offers")
def rollback_last_change(rows):
    """Ids are cleared, and the changes of the first suppliers undone."""
    cleared, changes = J.clear_ids(rows, E.contains_any(F.col("product_name"), ("bolt",)))
    # Rows that are equal in every column of pos are one place.
    batch = changes.distinct().filter(F.col("pos.l_suppkey") < 3)
    return J.rollback(cleared, batch).select("supplier", "supplier_code", "product_name", "product_id")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def ttl_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return J.latest(rows, ["user_id", "event_type"], "at").select("user_id", "event_type", "ts", "value")


# Events

def _payloads(rows):
    """JSON as a market gives it: per product its positions by kind and the names of its shops."""
    price = F.struct(F.round("price", 2).cast("decimal(18,2)").cast("string").alias("amount"))
    rows = rows.filter("product_id IS NOT NULL").withColumn("entry", F.struct(F.col("pos.l_suppkey").cast("string").alias("shop_id"), price.alias("position_price")))
    grouped = rows.groupBy("product_id").agg(F.collect_list("entry").alias("main"), F.map_from_entries(F.collect_set(F.struct("entry.shop_id", F.struct(F.col("supplier").alias("title"))))).alias("shops"))
    return grouped.select("product_id", F.to_json(F.struct(F.create_map(F.lit("main"), F.col("main")).alias("positions"), "shops")).alias("payload"))


@query("SELECT DISTINCT product_id, supplier AS seller, round(price, 2) AS price FROM offers WHERE product_id IS NOT NULL AND price > 0")
def offers_from_json(rows):
    return market_positions(_payloads(rows))


@query("SELECT product_id, count(*) AS n, round(min(price), 2) AS low, round(max(price), 2) AS high FROM offers WHERE product_id IS NOT NULL GROUP BY product_id")
def nested_prices(rows):
    """All prices of a payload, whatever their depth."""
    prices = _payloads(rows).select("product_id", F.explode(Y.nested_prices(F.col("payload"))).alias("price"))
    return prices.groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, max(value) AS high FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return V.per_window(table(spark, sf_dir, "events"))


@query(""", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS is_new FROM events),
h AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS stop, count(*) AS n FROM h GROUP BY user_id, s""")
def stream_session(spark, sf_dir):
    return V.sessions(table(spark, sf_dir, "events"))
