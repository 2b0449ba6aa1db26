"""Queries on decisions kept as versions, on batches of files and on nested payloads."""

import uuid

from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.operators import ledger as L
from priceloom.plans.registry import _KEY, query
from priceloom.sources import batch as B
from priceloom.sources import nested as V
from priceloom.sources.tables import offers, shared_folder, stored, table
from priceloom.streaming import freshness as Y

# Decisions

_ITEMS = f""", items AS (SELECT supplier, {_KEY} AS name_key, min(product_id::BIGINT)::VARCHAR AS product_id FROM offers GROUP BY 1, 2), names AS (SELECT list(DISTINCT supplier ORDER BY supplier) AS known FROM offers),
made AS (SELECT p_partkey AS number, known[(p_partkey // 8) % len(known) + 1] AS supplier, lower(p_name) AS name_key, CASE WHEN p_partkey % 10 = 3 THEN 'reject' WHEN p_partkey % 10 = 7 THEN 'clear' ELSE 'confirm' END AS action,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey END::VARCHAR AS product_id, p_partkey % 3 = 0 AS odd FROM part, names)"""


def _judged(before: str, after: str, seen: str) -> str:
    """SQL of a batch of decisions, judged by the items' state in `before`."""
    return f"""{after}_a AS (SELECT made.*, b.version, coalesce((SELECT bool_or(o.name_key <> made.name_key) FROM {before} o WHERE o.supplier = made.supplier AND o.product_id = made.product_id), false) AS held FROM made LEFT JOIN {before} b USING (supplier, name_key)),
{after}_b AS (SELECT *, CASE WHEN version IS NULL THEN 'gone' WHEN version <> {seen} THEN 'stale' WHEN held AND action = 'confirm' THEN 'conflict' END AS refused FROM {after}_a),
{after}_c AS (SELECT *, CASE WHEN refused IS NULL AND row_number() OVER (PARTITION BY supplier, name_key, refused IS NULL ORDER BY number) > 1 THEN 'later' ELSE refused END AS kept FROM {after}_b),
{after}_d AS (SELECT *, CASE WHEN kept IS NULL AND action = 'confirm' AND row_number() OVER (PARTITION BY supplier, CASE WHEN action = 'confirm' THEN product_id END, kept IS NULL ORDER BY number) > 1 THEN 'taken' ELSE coalesce(kept, 'accepted') END AS outcome FROM {after}_c)"""


_BATCHES = f"""{_ITEMS}, s0 AS (SELECT *, 0 AS version FROM items), {_judged("s0", "one", "CASE WHEN odd AND number % 5 = 0 THEN 1 ELSE 0 END")},
s1 AS (SELECT i.supplier, i.name_key, CASE WHEN outcome IS NULL THEN i.product_id WHEN action = 'confirm' THEN d.product_id END AS product_id, CASE WHEN outcome IS NULL THEN 0 ELSE 1 END AS version
  FROM items i LEFT JOIN (SELECT * FROM one_d WHERE outcome = 'accepted') d USING (supplier, name_key)), {_judged("s1", "two", "CASE WHEN odd THEN 1 ELSE 0 END")}"""


def _made(spark, sf_dir):
    rows = offers(spark, sf_dir)
    known = rows.agg(F.array_sort(F.collect_set("supplier")).alias("known"))  # one row; as many names as there are suppliers
    k = F.col("p_partkey")
    action = F.when(k % 10 == 3, "reject").when(k % 10 == 7, "clear").otherwise("confirm")
    supplier = F.element_at("known", (F.floor(k / 8) % F.size("known") + 1).cast("int"))
    parts = table(spark, sf_dir, "part").join(F.broadcast(known))
    made = parts.select(k.alias("number"), supplier.alias("supplier"), F.lower("p_name").alias("name_key"), action.alias("action"), F.when(k % 4 == 0, k + 1).otherwise(k).cast("string").alias("product_id"), F.lit(False).alias("duplicates"))
    return stored(L.items_of(rows.withColumn("name_key", X.name_key(F.col("product_name"))))), stored(made)


def _two_batches(spark, sf_dir):
    """The items, the log after a first batch, and a second batch of the same decisions, judged: some saw the versions before the first, some those after it."""
    items, made = _made(spark, sf_dir)
    k = F.col("number")
    first = L.judge(made.withColumn("seen", F.when((k % 3 == 0) & (k % 5 == 0), 1).otherwise(0).cast("long")), L.state(items, L.empty_log(spark)))
    log = stored(L.log_rows(first, 1))
    second = L.judge(made.withColumn("seen", F.when(k % 3 == 0, 1).otherwise(0).cast("long")), L.state(items, log))
    return items, log, first, second


@query(f"{_BATCHES} SELECT 1 AS batch, number, outcome FROM one_d UNION ALL SELECT 2, number, outcome FROM two_d")
def ledger_decisions(spark, sf_dir):
    """Two batches of decisions: which are refused as stale or conflicting, and which are accepted."""
    _, _, first, second = _two_batches(spark, sf_dir)
    return first.select(F.lit(1).alias("batch"), "number", "outcome").unionByName(second.select(F.lit(2).alias("batch"), "number", "outcome"))


@query(f"""{_BATCHES}, t AS (SELECT supplier, name_key FROM two_d WHERE outcome = 'accepted')
SELECT supplier, name_key, s1.product_id, CASE WHEN t.supplier IS NOT NULL THEN 3 ELSE version END::BIGINT AS version FROM s1 LEFT JOIN t USING (supplier, name_key)""")
def ledger_undo(spark, sf_dir):
    """The items after both batches and after undoing the second: its items have the ids from before it, and a new version."""
    items, log, _, second = _two_batches(spark, sf_dir)
    both = stored(log.unionByName(L.log_rows(second, 2)))
    return L.state(items, both.unionByName(L.undo_last(both, 3)))


# Files

_NUMBERED = """, numbered AS (SELECT split_part(supplier_code, '-', 2)::BIGINT % 3 AS kind, pos AS n, * EXCLUDE (pos) FROM offers WHERE price > 0)"""


@query(f"""{_NUMBERED} SELECT CASE kind WHEN 0 THEN 'Tradex' WHEN 1 THEN 'TGPC' ELSE 'Mine' END AS supplier, kind <> 1 AS coded, product_name, round(price, 2) AS price, CASE WHEN kind = 0 THEN warranty END AS warranty,
  CASE WHEN kind = 1 THEN product_id END AS product_id, CASE WHEN kind = 2 THEN round(rrp, 2) END AS rrp, count(*) AS n FROM numbered GROUP BY ALL""")
def batch_of_files(spark, sf_dir):
    """The offers as CSV files of three kinds, under headings of their own, loaded as one batch."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = offers(spark, sf_dir).filter("price > 0")
    code = F.concat(F.lit("c"), F.monotonically_increasing_id())
    kind = F.col("pos.l_suppkey") % 3
    kinds = {
        "tradex": {"Код": "code", "Наименование": "product_name", "Цена": F.round("price", 2).cast("decimal(18,2)"), "Гарантия": "warranty"},
        "price_bn": {"name": "product_name", "price": F.round("price", 2).cast("decimal(18,2)"), "id": F.concat("product_id", F.lit(".0"))},
        "others": {"sku": "code", "товар": "product_name", "Цена с НДС": F.round("price", 2).cast("decimal(18,2)"), "РРЦ": F.round("rrp", 2).cast("decimal(18,2)")},
    }
    for k, (name, columns) in enumerate(kinds.items()):
        # By partitions: a task without rows then writes no file, else the first writes one with a header only, which is no price list.
        # Numbered after the choice, which else waits until all kinds are joined.
        rows.filter(kind == k).withColumn("code", code).select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()], F.lit(name).alias("kind")).write.partitionBy("kind").csv(f"{folder}/in/{name}", header=True)
    B.load_batch(spark, f"{folder}/in/*/*", f"{folder}/table", [("others", "Mine")])
    coded = (F.coalesce("supplier_code", F.lit("")) != "").alias("coded")
    return B.current(spark, f"{folder}/table").groupBy("supplier", coded, "product_name", "price", "warranty", "product_id", "rrp").agg(F.count("*").alias("n"))


# Payloads

def _any_form(rows):
    """The offers of a product as a market might give them: by kind, as one list, or deep within other things."""
    rows = rows.filter("product_id IS NOT NULL")
    k = F.col("product_id").cast("long") % 3
    shop = F.col("pos.l_suppkey").cast("string")
    entry = F.struct(shop.alias("shop"), F.col("supplier").alias("title"), F.round("price", 2).cast("decimal(18,2)").cast("string").alias("amount"))
    shops = F.map_from_entries(F.collect_set(F.when(k < 2, F.struct(shop, F.struct(F.col("supplier").alias("title"))))))
    found = rows.groupBy("product_id").agg(F.collect_list(entry).alias("given"), shops.alias("shops"))
    price = lambda e: F.struct(e["amount"].alias("amount"))
    entries = F.transform("given", lambda e: F.struct(e["shop"].alias("shop_id"), price(e).alias("position_price")))
    wholes = F.transform("given", lambda e: F.struct(F.struct(e["shop"].alias("id"), e["title"].alias("title")).alias("shop"), F.struct(price(e).alias("BYN")).alias("x"), price(e).alias("price")))
    by_kind = F.to_json(F.struct(F.create_map(F.lit("main"), entries).alias("positions"), "shops"))
    one_list = F.to_json(F.struct(entries.alias("positions"), "shops"))
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(wholes.alias("rows"))).alias("blocks")).alias("data")))
    k = F.col("product_id").cast("long") % 3
    return found.select("product_id", F.when(k == 0, by_kind).when(k == 1, one_list).otherwise(deep).alias("payload"))


@query("SELECT DISTINCT product_id, split_part(supplier_code, '-', 2) AS seller_id, supplier AS seller, round(price, 2) AS price FROM offers WHERE product_id IS NOT NULL AND price > 0")
def nested_offers(rows):
    """Three forms of payloads give the same offers."""
    return V.nested_offers(_any_form(rows)).select("product_id", "seller_id", "seller", "price")


@query("SELECT product_id, count(*) AS n, round(min(price), 2) AS low, round(max(price), 2) AS high FROM offers WHERE product_id IS NOT NULL AND price > 0 AND product_id::BIGINT % 3 < 2 GROUP BY product_id")
def amounts_at_any_depth(rows):
    """All amounts of a position's price; the third form has none of that key."""
    return V.amounts(_any_form(rows)).groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


# Streams

@query("SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 6 hours")
def stream_freshness(spark, sf_dir):
    """The users' last events that are still fresh, by a stream over the table with a state and a timer for each user."""
    path, folder = f"{sf_dir}/events.parquet", f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # A pattern: streams take no path of a single file.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    Y.run(spark, events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("place"), "value"), 6 * 3600, f"{folder}/given", f"{folder}/checkpoint", "0 seconds")
    last = Y.standing(spark.read.parquet(f"{folder}/given")).filter("fresh")
    return last.select(F.col("key").cast("long").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
