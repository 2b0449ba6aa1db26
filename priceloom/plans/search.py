"""Queries on search, candidates and key sets, registered beside those of `registry`."""

import uuid

from pyspark.sql import functions as F

from priceloom.functions import scores as S
from priceloom.functions import text as X
from priceloom.operators import categories as G
from priceloom.operators import ids as I
from priceloom.operators import index as K
from priceloom.operators import matcher as M
from priceloom.operators import postings as O
from priceloom.operators import similarity as J
from priceloom.plans.more import _swapped
from priceloom.plans.registry import _KEY, _TOKENS, QUERIES, SQL, query
from priceloom.sources.tables import catalog, offers, shared_folder, table

# Substrings

_CODED = """, coded AS (SELECT p_partkey::VARCHAR AS product_id, upper(left(p_type, 3)) || '-' || p_partkey || ' x ' || p_size AS name FROM part),
asked AS (SELECT DISTINCT CASE k % 3 WHEN 0 THEN upper(left(category, 3)) || '-' || (k // 10) || ' x ' || warranty WHEN 1 THEN '[new]  ' || upper(left(category, 3)) || '-' || k || ' x ' || warranty
  ELSE lower(left(category, 3)) || '-' || k || 'rev x ' || warranty END AS product_name FROM (SELECT *, split_part(supplier_code, '-', 1)::BIGINT AS k FROM offers))"""


def _coded(spark, sf_dir):
    """The catalog under names with a code; and what suppliers call its products: codes cut short, names with a tag, codes with a revision."""
    code = lambda kind, k: F.concat(F.substring(kind, 1, 3), F.lit("-"), k.cast("string"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.concat(code(F.upper("p_type"), F.col("p_partkey")), F.lit(" x "), "p_size").alias("name"))
    k = F.col("pos.l_partkey")
    name = F.when(k % 3 == 0, code(F.upper("category"), F.floor(k / 10))).when(k % 3 == 1, F.concat(F.lit("[new]  "), code(F.upper("category"), k))).otherwise(F.concat(code(F.lower("category"), k), F.lit("rev")))
    return offers(spark, sf_dir).select(F.concat(name, F.lit(" x "), "warranty").alias("product_name")).distinct(), items


@query(f"""{_CODED}, keyed AS (SELECT product_name, trim(regexp_replace(regexp_replace(lower(product_name), '^\\s*\\[[^\\]]*\\]', ''), '\\s+', ' ', 'g')) AS key FROM asked),
exact AS (SELECT DISTINCT product_name, name, 1 AS step FROM keyed JOIN coded ON key = lower(name)),
words AS (SELECT product_name, regexp_extract(lower(product_name), '([a-z0-9][a-z0-9._/-]{{3,}})', 1) AS word FROM asked WHERE product_name NOT IN (SELECT product_name FROM exact)),
needles AS (SELECT product_name, word AS needle, 2 AS step FROM words UNION ALL SELECT product_name, regexp_extract(word, '^([a-z]{{1,4}}-?[0-9]{{3,5}})', 1), 3 FROM words WHERE regexp_extract(word, '^([a-z]{{1,4}}-?[0-9]{{3,5}})', 1) NOT IN ('', word)),
hits AS (SELECT * FROM exact UNION ALL SELECT DISTINCT product_name, name, step FROM needles JOIN coded ON lower(name) LIKE '%' || needle || '%'),
firsts AS (SELECT product_name, name, min(step) AS step FROM hits GROUP BY ALL)
SELECT product_name, name, step, 1 AS found, row_number() OVER (PARTITION BY product_name ORDER BY step, length(name), name)::INT AS rank FROM firsts""")
def ranked_like(spark, sf_dir):
    return O.ranked(O.ladder(*_coded(spark, sf_dir)))


@query(f"{_CODED} SELECT DISTINCT needle, name FROM (SELECT DISTINCT right(split_part(product_name, ' x ', 1), 4) AS needle FROM asked) JOIN coded ON lower(name) LIKE '%' || lower(needle) || '%'".replace("SELECT DISTINCT needle, name", "SELECT DISTINCT lower(needle) AS needle, name"))
def substring_join(spark, sf_dir):
    """The last four characters of every code, wherever they are in the catalog's names."""
    names, items = _coded(spark, sf_dir)
    needles = names.select(F.element_at(F.split("product_name", " x "), 1).alias("code")).select(F.expr("right(code, 4)").alias("needle"))
    # The index is many times its table, by whose size Spark would broadcast it.
    return O.names_with(needles, O.trigram_index(items, 3).hint("merge"), 3)


# A kept index

def fts_index_bm25(spark, sf_dir):
    """The search of fts_or_bm25 in an index of the catalog that is written first."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    K.write_index(catalog(spark, sf_dir), folder)
    return K.search(spark, folder, ["Wid", "small"])


QUERIES["fts_index_bm25"], SQL["fts_index_bm25"] = fts_index_bm25, SQL["fts_or_bm25"]


# Sets of words

_LIKE = f""", a AS (SELECT product_name, {_TOKENS.format('product_name', 2)} AS a FROM asked), b AS (SELECT product_id, name, {_TOKENS.format('name', 2)} AS b FROM coded),
pairs AS (SELECT product_name, product_id, name, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS exact FROM a JOIN b ON list_has_any(a, b)),
top AS (SELECT product_name, product_id, name, round(exact, 4) AS overlap, row_number() OVER (PARTITION BY product_name ORDER BY round(exact, 4) DESC, length(product_id), product_id)::INT AS rank FROM pairs)"""


@query(f"{_CODED}{_LIKE} SELECT product_name, product_id, name, overlap, rank FROM top WHERE rank <= 5")
def coded_top_candidates(spark, sf_dir):
    return J.best_overlaps(*_coded(spark, sf_dir))


@query(f"{_CODED}{_LIKE} SELECT DISTINCT product_name, name, round(exact, 4) AS overlap FROM pairs WHERE exact >= 0.6 - 1e-9")
def coded_similar_names(spark, sf_dir):
    names, items = _coded(spark, sf_dir)
    left, right = J.token_sets(names, "product_name", X.words(F.col("product_name"))), J.token_sets(items, "name", X.words(F.col("name")))
    held = J.frequencies(left, right)
    return J.overlapping(J.spread(J.by_rarity(left, "product_name", held)), J.spread(J.by_rarity(right, "name", held)), 0.6)


@query("""SELECT a.l_orderkey AS "row", b.l_orderkey AS target FROM (SELECT l_orderkey, list(DISTINCT l_partkey % 50) AS keys FROM lineitem GROUP BY 1) a
  JOIN (SELECT l_orderkey, list(DISTINCT l_partkey % 50) AS keys FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey % 50) >= 4) b ON list_has_all(a.keys, b.keys) AND a.l_orderkey <> b.l_orderkey""")
def key_set_containment(spark, sf_dir):
    """Orders whose kinds of products hold all those of another order with four kinds or more."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(F.collect_set((F.col("l_partkey") % 50).cast("string")).alias("keys"))
    targets = sets.filter(F.size("keys") >= 4).select(F.col("row").alias("target"), "keys")
    return J.containing(sets, targets).filter("row <> target")


@query(f"""SELECT supplier, product_name, category, coalesce(CASE WHEN one AND two THEN 'Fastened' WHEN two THEN 'Fastened' WHEN one THEN 'Supplied' END, category) AS chosen, count(*) AS n
  FROM (SELECT *, lower(supplier) = 'supplier#000000003' AND lower(product_name) LIKE 'red %' AS one, {_KEY} LIKE '% bolt' AS two FROM offers) GROUP BY ALL""")
def key_set_targets(spark, sf_dir):
    """Offers whose keys (of supplier and name, and of the name alone) meet chosen ones; the smallest target of several."""
    rows = offers(spark, sf_dir).withColumn("keys", G.item_keys(F.col("supplier"), F.col("product_name")))
    names = rows.select("product_name", "supplier").distinct()
    key = X.name_key(F.col("product_name"))
    wide = names.filter(key.endswith(" bolt")).select(F.concat(F.lit("name:"), key).alias("key"), F.lit("Fastened").alias("target"))
    narrow = names.filter((F.lower("supplier") == "supplier#000000003") & key.startswith("red ")).select(F.concat(F.lit("sname:"), X.supplier_token(F.col("supplier")), F.lit(":"), key).alias("key"), F.lit("Supplied").alias("target"))
    found = I.autosort(rows, wide.unionByName(narrow).distinct())
    return found.groupBy("supplier", "product_name", "category", F.coalesce("chosen", "category").alias("chosen")).agg(F.count("*").alias("n"))


# Scores of names

_WORDS = "list_filter(regexp_extract_all(lower({}), '[a-zа-я0-9]+'), lambda w: length(w) >= 2)[1:6]"
_LONG = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9._/-]{{2,}}'), lambda w: length(w) >= 4))"


@query(f""", sw AS (SELECT DISTINCT product_name, CASE WHEN product_id::BIGINT % 5 = 0 THEN (product_id::BIGINT + 1)::VARCHAR ELSE product_id END AS product_id FROM offers WHERE product_id IS NOT NULL AND NOT (product_id::BIGINT % 11 = 0 AND product_id::BIGINT % 5 <> 0)),
w AS (SELECT product_name, product_id, name, {_WORDS.format("product_name")} AS a, {_WORDS.format("name")} AS b, {_LONG.format("product_name")} AS x, {_LONG.format("name")} AS y FROM sw JOIN catalog USING (product_id)),
s AS (SELECT *, len(list_filter(list_zip(a[1:4], b[1:4]), lambda z: z[1] = z[2]))::DOUBLE / least(len(a), len(b), 4) AS prefix, len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) AS head,
  CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) ELSE 0 END AS tokens FROM w)
SELECT product_name, product_id, name, round(greatest(0.2 * prefix + 0.3 * head + 0.5 * tokens, 0.7), 3)::DOUBLE AS score FROM s""")
def id_scores(spark, sf_dir):
    pairs = _swapped(spark, sf_dir).filter("product_id IS NOT NULL").select("product_name", "product_id").distinct().join(catalog(spark, sf_dir).select("product_id", "name"), "product_id")
    return pairs.select("product_name", "product_id", "name", S.id_score(F.col("product_name"), F.col("name")).alias("score"))


# The matcher and the resolver where rules decide

_NAMED = """, named AS (SELECT k, k % 3 AS kind, k // 12 AS block, (k // 3) % 2 AS x, (k // 6) % 2 AS y FROM (SELECT p_partkey AS k FROM part))"""
_VERDICT = """CASE a.kind WHEN 0 THEN CASE WHEN a.x = b.x THEN 'strict_article' ELSE 'strict_article_conflict' END
  WHEN 1 THEN CASE WHEN a.x <> b.x THEN 'tgpc_code_mismatch' WHEN a.y <> b.y THEN 'tgpc_gpu_mismatch' ELSE 'tgpc_code_exact' END
  ELSE CASE WHEN a.x <> b.x THEN 'model_variant_conflict' WHEN a.y <> b.y THEN 'motherboard_brand_mismatch' ELSE 'motherboard_model' END END"""


def _named(spark, sf_dir, offered):
    """Names of laptops with an article, of assembled computers and of motherboards, as offered or as listed."""
    k = F.col("p_partkey")
    block, x, y = (F.floor(k / 12) + 1000).cast("string"), F.floor(k / 3) % 2, F.floor(k / 6) % 2
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    article = text("90NR.", block, "A", x, ".00", x)
    laptop = text("Ноутбук ASUS ", article) if offered else text("ASUS laptop (", article, ")")
    # Numbers of computers have four to six digits, so those of many blocks come round again.
    number = text((F.floor(k / 12) % 90_000 + 1000).cast("string"), x)
    computer = text("Игровой ПК ", number, " A-X RTX ", 4060 + y * 10) if offered else text("Компьютер ", number, " B-X, RTX ", 4060 + y * 10)
    maker, chipset = F.when(y == 0, "ASUS").otherwise("MSI"), text("B", 550 + x * 100, "M")
    board = text("Материнская плата ", maker, " ", chipset, " Plus") if offered else text("MB ", F.lower(maker), " ", chipset, " PLUS, RTL")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.floor(k / 12).alias("block"), (k % 3).alias("kind"), F.when(k % 3 == 0, laptop).when(k % 3 == 1, computer).otherwise(board).alias("said"))


@query(f"""{_NAMED}, p AS (SELECT a.k, b.k AS other, {_VERDICT} AS reason FROM named a JOIN named b ON a.block = b.block AND a.kind = b.kind)
SELECT k, other, CASE reason WHEN 'strict_article' THEN 1.0 WHEN 'strict_article_conflict' THEN 0.16 WHEN 'tgpc_code_mismatch' THEN 0.04 WHEN 'tgpc_gpu_mismatch' THEN 0.35 WHEN 'tgpc_code_exact' THEN 1.0 WHEN 'model_variant_conflict' THEN 0.14 WHEN 'motherboard_brand_mismatch' THEN 0.04 ELSE 0.996 END::DOUBLE AS score,
  reason IN ('strict_article', 'tgpc_code_exact', 'motherboard_model') AS match, reason FROM p""")
def match_scores_by_rules(spark, sf_dir):
    """Pairs of names that articles, codes and models decide."""
    a = _named(spark, sf_dir, True).withColumnRenamed("said", "product_name")
    b = _named(spark, sf_dir, False).select(F.col("k").alias("other"), "block", "kind", F.col("said").alias("name"))
    judged = M.match_names(a.join(b, ["block", "kind"]).select("k", "other", "product_name", "name"))
    return judged.select("k", "other", "score", "match", "reason")


@query(f"""{_NAMED}, n AS (SELECT block, x, min(k) AS k FROM named WHERE kind = 0 GROUP BY ALL), c AS (SELECT block, x, list(k::VARCHAR ORDER BY length(k::VARCHAR), k::VARCHAR) AS ids FROM named WHERE kind = 0 GROUP BY ALL)
SELECT k, CASE WHEN k % 9 = 0 THEN ids[2] ELSE ids[1] END AS best_id, CASE WHEN k % 9 = 0 AND len(ids) = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
  CASE WHEN k % 9 = 0 THEN CASE len(ids) WHEN 1 THEN 'none' WHEN 2 THEN 'strong' ELSE 'ambiguous' END WHEN len(ids) > 1 THEN 'ambiguous' ELSE 'strong' END AS tier FROM n JOIN c USING (block, x)""")
def noid_resolver_by_article(spark, sf_dir):
    """Offers whose names are not in the catalog, but whose articles are: several items with one article are ambiguous, a rejected one doesn't count."""
    named = _named(spark, sf_dir, True).filter("kind = 0")
    tasks = named.groupBy("said").agg(F.min("k").alias("k")).select("k", F.lit("S").alias("supplier"), X.name_key(F.col("said")).alias("name_key"), F.col("said").alias("product_name"))
    tasks = tasks.withColumn("item_key", F.col("k").cast("string"))
    items = _named(spark, sf_dir, False).filter("kind = 0").select(F.col("k").cast("string").alias("product_id"), F.col("said").alias("name"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("brand"))
    gone = tasks.filter(F.col("k") % 9 == 0).select("supplier", "name_key", F.col("k").cast("string").alias("product_id"))
    found = I.resolve(tasks, items, gone)
    return found.select(F.col("item_key").cast("long").alias("k"), "best_id", "score", "tier")
