"""Queries on reports, badges, whole exports and small joins, registered beside those of `registry`."""

from pyspark.sql import functions as F

from priceloom.functions import payloads as Y
from priceloom.functions import text as X
from priceloom.operators import catalog as C
from priceloom.operators import consolidate as K
from priceloom.operators import effective as A
from priceloom.operators import export as E
from priceloom.operators import ids as I
from priceloom.operators import paging as P
from priceloom.operators import review as W
from priceloom.plans.registry import _KEY, _REASON, _TOKENS, CORE, _CORE, query
from priceloom.sources.tables import offers, table

# Quality

_FAULTS = f""", k AS (SELECT *, {_KEY} AS key, row_number() OVER (ORDER BY pos) AS place, count(*) OVER (PARTITION BY lower(trim(supplier)), {_KEY}) AS n FROM offers),
faults AS (SELECT 'missing_id' AS issue, '' AS detail, * FROM k WHERE product_id IS NULL UNION ALL SELECT 'price', {_REASON}, * FROM k WHERE {_REASON} IS NOT NULL UNION ALL SELECT 'duplicate', 'x' || n, * FROM k WHERE n > 1)"""


@query(f"{_FAULTS} SELECT issue, detail, supplier, category, product_name, price, rrp, count(*) AS n FROM faults GROUP BY ALL")
def quality_report(rows):
    report = E.quality_report(rows)
    return report.groupBy("issue", "detail", "supplier", "category", "product_name", "price", "rrp").agg(F.count("*").alias("n"))


@query(f"""{_FAULTS}, lines AS (SELECT issue, pos, CASE issue WHEN 'duplicate' THEN '[' || supplier || '] ' || product_name || ' (' || detail || ')' WHEN 'price' THEN '[' || category || '] ' || product_name || ' | ' || detail || ' | ' || round(price, 2)::DECIMAL(18,2) || ' / ' || round(rrp, 2)::DECIMAL(18,2)
  ELSE '[' || category || '] ' || product_name END AS line FROM faults), ranked AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY pos, line) AS nth, count(*) OVER (PARTITION BY issue) AS n FROM lines)
SELECT issue, any_value(n) AS n, string_agg(line, chr(10) ORDER BY nth) FILTER (nth <= 8) AS samples FROM ranked GROUP BY issue""")
def quality_samples(rows):
    """The first eight offers of each kind of fault."""
    return E.quality_samples(E.quality_report(rows))


# Exports

_PC = "regexp_matches(lower(product_name), 'gear|widget')"


@query(f"""SELECT supplier, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT * FROM (SELECT *, count(*) OVER w AS n_ids FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, pos) AS nth FROM offers
  WHERE product_id IS NOT NULL AND category <> 'ECONOMY' AND NOT (category = 'PROMO' AND contains(product_name, 'bolt')) AND NOT contains(product_name, 'rod')) WHERE nth = 1 WINDOW w AS (PARTITION BY product_id)))
  WHERE supplier <> 'Supplier#000000002' OR {_PC} GROUP BY supplier""")
def export_counted(rows):
    """The export with the options under which a page counts it: only offers with an id, the cheapest of each."""
    hidden = rows.sparkSession.createDataFrame([("economy ",), ("Bolts",)], "category string")
    effective = F.when((F.col("category") == "PROMO") & F.col("product_name").contains("bolt"), "bolts").otherwise(F.col("category"))
    rules = E.ExportRules(deny_name_parts=("ROD",), include_without_id=E.COUNTED.include_without_id, keep_lowest=E.COUNTED.keep_lowest)
    kept = E.export_chain(rows, rules, hidden, effective, ("Supplier#000000003",), (" supplier#000000002",), F.lower("product_name").rlike("gear|widget"))
    return kept.groupBy("supplier").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(f"""SELECT {_CORE}, count(*) AS n FROM (SELECT *, CASE WHEN supplier = 'Supplier#000000003' AND product_id IS NOT NULL THEN (SELECT count(DISTINCT lower(p_name)) FROM part WHERE p_partkey // 2 = product_id::BIGINT // 2) ELSE 1 END AS names FROM offers WHERE category <> 'ECONOMY')
  WHERE NOT (names > 1) GROUP BY ALL""".replace("FROM part WHERE p_partkey // 2 = product_id::BIGINT // 2", "FROM offers o WHERE o.product_id::BIGINT // 2 = offers.product_id::BIGINT // 2 AND o.category <> 'ECONOMY'").replace("lower(p_name)", "lower(o.product_name)"))
def export_whole(rows):
    """The export with its own options, in which two products share each id; offers of one supplier whose id has several names go."""
    shared = rows.withColumn("own_id", F.col("product_id")).withColumn("product_id", F.floor(F.col("product_id").cast("long") / 2).cast("string"))
    hidden = rows.sparkSession.createDataFrame([("Economy",)], "category string")
    kept = E.export_chain(shared, E.ExportRules(), hidden, None, ("Supplier#000000003",)).withColumn("product_id", F.col("own_id"))
    return kept.groupBy(*CORE).agg(F.count("*").alias("n"))


# Badges and previews

_BADGED = """SELECT CASE k % 5 WHEN 0 THEN 'IVEN' WHEN 1 THEN ' N-Tech' WHEN 2 THEN 'Iven zakaz' WHEN 3 THEN 'TRADEX' ELSE 'Other' END AS supplier, k % 5 AS s, product_id, contains(product_name, 'gear') AS pc, contains(product_name, 'nut') OR contains(product_name, 'bolt') AS laptop,
  CASE category WHEN 'ECONOMY' THEN 'Процессор' WHEN 'SMALL' THEN 'Кулеры' WHEN 'LARGE' THEN 'Мышь' WHEN 'PROMO' THEN 'МФУ' ELSE 'Прочее' END AS category FROM (SELECT *, split_part(supplier_code, '-', 2)::BIGINT AS k FROM offers)"""
_EVERY = ", ".join(f"('{b}')" for b in P.BADGES)


@query(f"""SELECT badge, coalesce(n, 0) AS n FROM (VALUES {_EVERY}) b(badge) LEFT JOIN (SELECT CASE WHEN s = 0 AND pc THEN 'iven-pc' WHEN s = 0 AND laptop THEN 'iven-laptop' WHEN s = 2 AND laptop THEN 'iven-zakaz-laptop' WHEN s = 3 AND laptop THEN 'tradex-laptop' WHEN s = 1 AND pc THEN 'ntech-pc'
  WHEN s = 1 THEN CASE category WHEN 'Процессор' THEN 'cpu' WHEN 'Кулеры' THEN 'cooler' WHEN 'МФУ' THEN 'printer' WHEN 'Мышь' THEN 'mouse' ELSE 'misc' END END AS badge, count(*) AS n FROM ({_BADGED}) WHERE product_id IS NULL GROUP BY 1) USING (badge)""")
def badges_of_a_page(rows):
    """All badges, those without an offer too."""
    k, name = F.col("pos.l_suppkey") % 5, F.col("product_name")
    supplier = F.coalesce(*[F.when(k == n, s) for n, s in enumerate(("IVEN", " N-Tech", "Iven zakaz", "TRADEX"))], F.lit("Other"))
    category = F.coalesce(*[F.when(F.col("category") == c, named) for c, named in (("ECONOMY", "Процессор"), ("SMALL", "Кулеры"), ("LARGE", "Мышь"), ("PROMO", "МФУ"))], F.lit("Прочее"))
    return P.badge_counts(rows, P.badge(supplier, category, name.contains("gear"), name.contains("nut") | name.contains("bolt"), {"Мышь": "mouse", "Кабель": "cables"}))


@query("""SELECT brand, n, n_changed, n_priced, coalesce(examples, '') AS examples FROM (SELECT brand, count(*) AS n, count(*) FILTER (category <> brand) AS n_changed, count(*) FILTER (price > 20000) AS n_priced FROM offers GROUP BY brand)
  LEFT JOIN (SELECT brand, string_agg(product_name, '; ' ORDER BY product_name) AS examples FROM (SELECT brand, product_name, row_number() OVER (PARTITION BY brand ORDER BY product_name) AS k FROM (SELECT DISTINCT brand, product_name FROM offers WHERE category <> brand)) WHERE k <= 4 GROUP BY brand) USING (brand)""")
def category_targets(rows):
    """What each target category would get, with examples."""
    return P.category_preview_counts(rows, "category", "brand", F.col("price") > 20000, "product_name")


# Keys, tokens, codes and maps

@query(f"SELECT CASE WHEN k % 3 = 0 THEN 'code:' || supplier_code WHEN k % 3 = 1 THEN 'name:' || {_KEY} ELSE 'row:' || k END AS row_key, count(*) AS n FROM (SELECT *, split_part(supplier_code, '-', 1)::BIGINT AS k FROM offers) GROUP BY 1")
def row_keys_of_all_kinds(rows):
    """Keys by code, by name where there is no code, and by place where there is neither."""
    k = F.col("pos.l_partkey")
    bare = rows.withColumns({"supplier_code": F.when(k % 3 == 0, F.col("supplier_code")).when(k % 3 == 1, " "), "product_name": F.when(k % 3 != 2, F.col("product_name")).when(k % 2 == 0, " [x] ")})
    return bare.groupBy(K.row_key(k).alias("row_key")).agg(F.count("*").alias("n"))


@query(f""", p AS (SELECT s_suppkey::VARCHAR AS id, 'maker' || s_nationkey || ' type' || s_suppkey % 7 || ' code' || s_suppkey AS name FROM supplier), t AS (SELECT id, unnest({_TOKENS.format('name', 4)}) AS token FROM p),
a AS (SELECT DISTINCT 'maker' || s_nationkey || ' type' || s_suppkey % 7 || CASE WHEN s_suppkey % 2 = 0 THEN ' code' || s_suppkey ELSE ' none' || s_suppkey END AS product_name FROM supplier), b AS (SELECT product_name, {_TOKENS.format('product_name', 4)} AS tokens FROM a),
u AS (SELECT token, min(id) AS found_id FROM t GROUP BY token HAVING count(DISTINCT id) = 1), h AS (SELECT product_name, arg_min(struct_pack(t := token, f := found_id), strpos(product_name, token)) AS hit FROM b JOIN u ON list_contains(tokens, token) GROUP BY 1),
s AS (SELECT product_name, id, count(*)::DOUBLE / any_value(len(tokens)) AS part FROM b JOIN t ON list_contains(tokens, token) WHERE product_name NOT IN (SELECT product_name FROM h) GROUP BY 1, 2)
SELECT product_name, hit.t AS token, hit.f AS found_id FROM h UNION ALL SELECT product_name, NULL, arg_min(id, (-part, length(id), id)) FROM s WHERE part >= 0.55 GROUP BY 1""")
def token_overlap_lookup(spark, sf_dir):
    """Ids by a token that only one product has, else by the largest part of the tokens."""
    s = table(spark, sf_dir, "supplier")
    base = F.concat(F.lit("maker"), "s_nationkey", F.lit(" type"), F.col("s_suppkey") % 7)
    items = s.select(F.col("s_suppkey").cast("string").alias("product_id"), F.concat(base, F.lit(" code"), "s_suppkey").alias("name"))
    names = s.select(F.concat(base, F.when(F.col("s_suppkey") % 2 == 0, " code").otherwise(" none"), F.col("s_suppkey")).alias("product_name"))
    return C.overlap_ids(names, items)


@query("""SELECT 'Игровой ПК ' || (10000 + a.p_partkey // 2) || ' A-X RTX ' || (4060 + a.p_partkey % 2 * 10) AS product_name, b.p_partkey::VARCHAR AS product_id, CASE WHEN b.p_size % 3 = 0 OR a.p_partkey % 2 = b.p_size % 2 THEN 1.0 ELSE 0.35 END::DOUBLE AS score
  FROM part a JOIN part b ON a.p_partkey // 2 = b.p_partkey // 3 AND b.p_partkey % 5 > 0""")
def assembled_code_join(spark, sf_dir):
    """Assembled computers by the number in their names: the catalog says another card for some, and none for others."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    names = p.select(F.concat(F.lit("Игровой ПК "), 10000 + F.floor(k / 2), F.lit(" A-X RTX "), 4060 + k % 2 * 10).alias("product_name"))
    card = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" RTX "), 4060 + F.col("p_size") % 2 * 10)).otherwise("")
    items = p.select(k.cast("string").alias("product_id"), F.when(k % 5 > 0, F.concat(F.lit("Компьютер "), 10000 + F.floor(k / 3), F.lit(" B-X"), card)).otherwise(F.concat(F.lit("Компьютер "), k)).alias("name"))
    return I.code_join(names, items)


@query("""SELECT category, brand AS key, max(price) AS high FROM (SELECT category, CASE WHEN lower(brand) LIKE '%3' THEN 'three' ELSE lower(brand) END AS brand, price FROM offers) GROUP BY ALL
  UNION ALL SELECT category, 'four', max(price) FROM offers WHERE lower(brand) = 'brand#4' GROUP BY 1""")
def updated_maps(rows):
    """A category's map of brands and prices under new keys, several of which become one, with a copy under a further key."""
    entries = rows.groupBy("category", "brand").agg(F.max("price").alias("high"))
    # Of keys that become one the first in order stays, so all get the largest price of those.
    key = F.when(F.lower("brand").endswith("3"), "three").otherwise(F.lower("brand"))
    top = entries.groupBy("category", key.alias("one")).agg(F.max("high").alias("top"))
    maps = entries.withColumn("one", key).join(top, ["category", "one"]).groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("brand", "top"))).alias("m"))
    rename = lambda c: F.when(F.lower(c).endswith("3"), "three").otherwise(F.lower(c))
    return maps.select("category", F.explode(Y.normalized_map(F.col("m"), None, rename, {"four": "brand#4"})).alias("key", "high"))


@query()
def peripheral_matches(spark, sf_dir):
    """Peripherals that share words with what suppliers call them. No SQL: the scores rest on the likeness of texts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("Мышь", "Клавиатура", "Наушники", "Монитор"))), (k % 4 + 1).cast("int"))
    items = p.select(k.cast("string").alias("product_id"), F.concat(kind, F.lit(" "), "p_name", F.when(k % 3 == 0, " pro").otherwise("")).alias("name"))
    return W.peripheral_candidates(p.select(F.concat(kind, F.lit(" "), "p_name").alias("product_name")).distinct(), items)


# Categories

@query("""SELECT supplier, category, holds, count(*) AS n FROM (SELECT *, CASE WHEN product_id IS NOT NULL AND k % 3 = 0 THEN 'Listed ' || brand WHEN k % 5 = 0 THEN 'Named' WHEN k % 7 = 0 AND k % 2 = 0 THEN 'Chosen'
  WHEN product_id IS NOT NULL THEN CASE WHEN contains(product_name, 'gear') THEN 'Cogs' ELSE 'Требует сортировки · родитель: ' || category END
  WHEN contains(product_name, 'bolt') THEN 'Fasteners' WHEN s = 4 THEN 'Over' ELSE 'Требует сортировки · родитель: ' || category END AS holds
  FROM (SELECT *, split_part(supplier_code, '-', 1)::BIGINT AS k, split_part(supplier_code, '-', 2)::BIGINT AS s FROM offers)) GROUP BY ALL""")
def category_holds(rows):
    """The precedence of all that say a category; the tables' own look like a supplier's."""
    k, name, own = F.col("pos.l_partkey"), F.col("product_name"), lambda test, value: F.when(test, value)
    holds = A.precedence(
        F.col("product_id").isNotNull(), own(k % 3 == 0, F.concat(F.lit("Listed "), "brand")), own(k % 5 == 0, "Named"), own(k % 7 == 0, F.when(k % 2 == 0, "Chosen").otherwise("RAW")),
        own(name.contains("gear"), "Cogs"), own(name.contains("bolt"), "Fasteners"), own(F.col("pos.l_suppkey") == 4, "Over"), F.lit(None).cast("string"), F.col("category"),
    )
    return rows.groupBy("supplier", "category", holds.alias("holds")).agg(F.count("*").alias("n"))
