"""Offers from JSON payloads of any shape, as variants: no schema is fixed, and no depth.

A payload gives offers in its positions: lists by kind, or one list. One that gives none there is searched whole, a level at
a time: every object with a price is an offer. A payload stays one row to the end, with what was found in it and with its
parts that are still to be searched, so that payloads need no shuffle; after LEVELS levels those with deeper parts are written
and searched on. Payloads that are no JSON give nothing, and prices that are not positive are none. Offers of one payload that
agree in seller, price and address are one.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.sources.tables import discard, stored

# Where offers have their price and seller, first that is there; "—" is a seller without a name.
PRICES = ("position_price.converted.BYN.amount", "position_price.amount", "price.converted.BYN.amount", "price.amount", "price")
SELLER_IDS, SELLER_URLS, SELLER_NAMES = ("seller_id", "shop_id", "vendor_id"), ("shop_url", "seller_url"), ("seller_name", "shop_name", "vendor_name")
SELLERS = ("shop", "seller", "vendor", "merchant", "store")
NAMES, IDS, URLS = ("title", "name", "full_name"), ("id", "key"), ("html_url", "url")
ADDRESSES = ("product_url", "html_url", "url")
NO_NAME = "—"
#: Levels of a payload that are searched before what lies deeper is written.
LEVELS = 8


def _fields(paths) -> str:
    """The type of an object that has texts at these paths."""
    inner: dict[str, list[str]] = {}
    for p in paths:
        first, _, rest = p.partition(".")
        inner.setdefault(first, []).extend([rest] if rest else [])
    return "struct<" + ",".join(f"`{k}`:{_fields(rest) if rest else 'string'}" for k, rest in inner.items()) + ">"


#: What is read of an offer, all at once; "price" may be a value or an object.
SAID = _fields([*[p for p in PRICES if not p.startswith("price")], *SELLER_IDS, *SELLER_URLS, *SELLER_NAMES, *[f"{s}.{n}" for s in SELLERS for n in (*NAMES, *IDS, *URLS)], *dict.fromkeys(ADDRESSES), "warranty", "stock_status.text", "date_update"]).replace("struct<", "struct<price:variant,", 1)
SHOP = _fields([*NAMES[:2], *URLS])


def said(given: Column, paths) -> Column:
    """The first of the texts at these paths that isn't blank, null if all are."""
    texts = [reduce(lambda c, k: c[k], p.split("."), given) for p in paths]
    # Most texts begin and end with a plain character, and need no search for white space.
    plain = lambda t: F.ascii(t).between(33, 126) & F.ascii(F.substring(t, -1, 1)).between(33, 126)
    return F.coalesce(*[F.when(plain(t), t).when(t.isNotNull(), F.nullif(X.strip(t), F.lit(""))) for t in texts])


def children(nodes: Column) -> Column:
    """What the nodes (an array of variants) hold."""
    held = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))
    return F.flatten(F.filter(F.transform(nodes, held), lambda x: x.isNotNull()))


def _prices(given: Column) -> Column:
    """The texts at PRICES, those that are there; an object is no number, and would be long tried as one."""
    at = lambda p: F.try_variant_get(given["price"], f"${p.removeprefix('price')}", "string") if p.startswith("price") else reduce(lambda c, k: c[k], p.split("."), given)
    return F.filter(F.array(*map(at, PRICES)), lambda t: t.isNotNull() & ~t.startswith("{"))


def _seller(given: Column, own_id: Column, own_url: Column) -> Column:
    """id, name and url of the seller as the offer itself says them."""
    inner = F.transform(F.array_compact(F.array(*[given[s] for s in SELLERS])), lambda m: F.struct(said(m, NAMES).alias("name"), F.coalesce(said(m, IDS), own_id).alias("id"), F.coalesce(said(m, URLS), own_url).alias("url")))
    return F.coalesce(F.get(F.filter(inner, lambda m: F.coalesce(m["name"], m["id"], m["url"]).isNotNull()), F.lit(0)), F.struct(F.lit(None).cast("string").alias("name"), own_id.alias("id"), own_url.alias("url")))


def _priced(objects: Column) -> Column:
    """What those of the objects (an array of SAID, null for what is no object) say that are offers."""
    # Each step is an array of its own: within a function of an array Spark works out again whatever is named twice.
    numbers = F.transform(F.array_compact(objects), lambda g: F.struct(F.filter(F.transform(_prices(g), X.number), X.finite).alias("numbers"), g.alias("given")))
    priced = F.transform(numbers, lambda o: F.struct(F.round(F.get(o["numbers"], F.lit(0)), 2).alias("price"), o["given"].alias("given")))
    owned = F.transform(F.filter(priced, lambda o: o["price"] > 0), lambda o: F.struct(o["price"].alias("price"), o["given"].alias("given"), said(o["given"], SELLER_IDS).alias("id"), said(o["given"], SELLER_URLS).alias("url")))
    return F.transform(
        owned,
        lambda o: F.struct(
            o["price"].alias("price"), _seller(o["given"], o["id"], o["url"]).alias("seller"), said(o["given"], SELLER_NAMES).alias("said_name"), said(o["given"], ADDRESSES).alias("address"),
            said(o["given"], ("warranty",)).alias("warranty"), said(o["given"], ("stock_status.text",)).alias("stock"), said(o["given"], ("date_update",)).alias("updated_at"),
        ),
    )


def _of_nodes(nodes: Column) -> Column:
    return _priced(F.transform(nodes, lambda v: F.try_variant_get(v, "$", SAID)))


def every_part(roots: DataFrame, read: Callable[[Column], Column], *columns: str) -> list[DataFrame]:
    """Written tables of the columns and `found`, a row for each root in all: what `read` finds in an array of nodes, for the root and all that it holds at any depth."""
    level, out = roots.select(*columns, F.array("node").alias("at_0"), F.lit(None).alias("found")), []
    while not out or not level.isEmpty():
        for k in range(LEVELS):
            level = level.withColumn(f"at_{k + 1}", children(F.col(f"at_{k}")))
        now = read(F.concat(*[F.col(f"at_{k}") for k in range(LEVELS)]))
        holds = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull()
        out.append(stored(level.select(*columns, (F.concat("found", now) if out else now).alias("found"), F.filter(F.col(f"at_{LEVELS}"), holds).alias("at_0"))))
        level = out[-1].filter(F.size("at_0") > 0)
    return out


def _found(steps: list[DataFrame], *columns: str) -> DataFrame:
    """The rows of every_part(), each from the table that it came to its end in."""
    return reduce(DataFrame.unionAll, [s.filter(F.size("at_0") == 0).select(*columns, "found") for s in steps])


def _listed(node: Column) -> Column:
    """The entries (SAID) of a payload's positions, which are one list, or lists by kind."""
    kinds = F.map_values(F.try_variant_get(node, "$.positions", f"map<string,array<{SAID}>>"))
    return F.coalesce(F.try_variant_get(node, "$.positions", f"array<{SAID}>"), F.flatten(F.filter(kinds, lambda x: x.isNotNull())), F.array().cast(f"array<{SAID}>"))


def nested_offers(payloads: DataFrame) -> DataFrame:
    """product_id, seller_id, seller, seller_url, price, url, warranty, stock, updated_at from payloads (product_id, payload)."""
    # Payloads never meet: each is a row of its own, and offers of equal ones become one at the end.
    shops = F.transform_values(F.try_variant_get("node", "$.shops", f"map<string,{SHOP}>"), lambda k, s: F.struct(said(s, NAMES[:2]).alias("shop_name"), said(s, URLS).alias("shop_url")))
    roots = payloads.select("product_id", F.try_parse_json("payload").alias("node")).select("product_id", "node", shops.alias("shops"), _priced(_listed(F.col("node"))).alias("found"))
    roots = stored(roots.select("product_id", "shops", "found", F.when(F.size("found") == 0, F.col("node")).alias("node")))
    columns = ["product_id", "shops"]
    steps = every_part(roots.filter(F.size("found") == 0), _of_nodes, *columns)
    rows = roots.filter(F.size("found") > 0).select(*columns, "found").unionAll(_found(steps, *columns))
    blank = lambda c: F.coalesce(c, F.lit(""))
    # Sellers are looked up within the payload.
    rows = rows.select("product_id", F.transform("found", lambda o: F.struct(o.alias("o"), F.try_element_at("shops", o["seller"]["id"]).alias("shop"))).alias("found"))

    def entry(x: Column) -> Column:
        o, url = x["o"], F.coalesce(x["o"]["seller"]["url"], x["shop"]["shop_url"])
        return F.struct(
            blank(o["seller"]["id"]).alias("seller_id"), F.coalesce(o["seller"]["name"], x["shop"]["shop_name"], o["said_name"], F.lit(NO_NAME)).alias("seller"), o["price"].alias("price"), blank(F.coalesce(o["address"], url)).alias("url"),
            blank(url).alias("seller_url"), *[blank(o[c]).alias(c) for c in ("warranty", "stock", "updated_at")],
        )

    # Offers that are one come together when sorted; the first of them stays.
    rows = rows.select("product_id", F.array_sort(F.transform("found", entry)).alias("found"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c] == b[c] for c in ("seller_id", "seller", "price", "url")])
    one = rows.select("product_id", F.explode(F.filter("found", lambda x, i: (i == 0) | ~same(x, F.get("found", i - 1)))).alias("o"))
    out = stored(one.select("product_id", *[f"o.{c}" for c in ("seller_id", "seller", "seller_url", "price", "url", "warranty", "stock", "updated_at")]).distinct())
    discard(roots, *steps)
    return out


def amounts(payloads: DataFrame, key: str = "position_price") -> DataFrame:
    """product_id and price: the positive amounts of all objects of that key, at any depth; as many rows as there are such objects."""
    roots = payloads.select("product_id", F.try_parse_json("payload").alias("node"))
    amount = lambda v: X.money(F.try_variant_get(v, f"$.{key}.amount", "string"))
    steps = every_part(roots, lambda nodes: F.filter(F.transform(nodes, amount), lambda p: p > 0), "product_id")
    return _found(steps, "product_id").select("product_id", F.explode("found").alias("price"))
