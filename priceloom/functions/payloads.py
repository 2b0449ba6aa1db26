"""Values out of JSON texts whose shape varies, as column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.functions import text as X

# Under which names payloads give lists, ids and prices.
LISTS = ("items", "sections", "manufacturers", "products", "data", "results")
IDS = ("id", "section_id", "manufacturer_id", "product_id", "sectionId", "manufacturerId", "productId")
PROMO, PRICES = ("pricePromo", "price_promo", "promoPrice"), ("price", "Price", "cost", "amount")
AMOUNTS = ("amount", "value", "BYN", "byn", "converted")


def _positive(value: Column) -> Column:
    number = X.money(value)
    return F.when(number > 0, number)


def row_price(row: Column) -> Column:
    """The price of a JSON row: the first positive one, promotions first; a price may be a number, a text or an object with an amount."""
    given = fields(row)

    def value(key: str) -> Column:
        text = F.try_element_at(given, F.lit(key))
        # The row is read again only for an object that holds such an amount.
        inner = [F.when(text.contains(f'"{a}"'), F.coalesce(*[_positive(F.get_json_object(row, f"$.{key}.{a}{rest}")) for rest in (".amount", ".value", "")])) for a in AMOUNTS]
        return F.coalesce(_positive(text), F.when(text.startswith("{"), F.coalesce(*inner)))

    return F.coalesce(*map(value, (*PROMO, *PRICES)))


def fields(row: Column) -> Column:
    """The fields of a JSON object as texts, read at once; null for anything else."""
    return F.from_json(F.when(row.rlike(r"^\s*\{"), row), "map<string,string>", {"allowNonNumericNumbers": "false"})


def nested_prices(payload: Column) -> Column:
    """All positive amounts of a position_price, at any depth, in the order of the text."""
    inner = r'(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*?'
    found = F.regexp_extract_all(payload, F.lit(r'"position_price"\s*:\s*\{' + inner + r'"amount"\s*:\s*"?([0-9][0-9 .,]*)'), F.lit(1))
    return F.filter(F.transform(found, X.money), lambda p: p > 0)


def listed(payload: Column) -> Column:
    """The JSON rows of a payload: the payload if it is a list, else the list under the first of LISTS that has one, one level down too."""
    rows = lambda path: F.from_json(F.get_json_object(payload, path), "array<string>")
    is_list = lambda path: F.get_json_object(payload, path).startswith("[")
    paths = ["$", *[f"$.{k}" for k in LISTS], *[f"$.{k}.{j}" for k in LISTS for j in LISTS]]
    return F.coalesce(*[F.when(is_list(p), rows(p)) for p in paths], F.array().cast("array<string>"))


def row_id(row: Column) -> Column:
    """The id of a JSON row: the first of IDS that is filled, else the number that its address ends with."""
    given = fields(row)
    field = lambda k: F.try_element_at(given, F.lit(k))
    plain = [F.when(field(k) != "", field(k)) for k in IDS]
    address = F.coalesce(*map(field, ("url", "href", "link")))
    ending = F.regexp_extract(F.trim(address), r"/(\d+)/?$", 1)
    return F.coalesce(*map(F.trim, plain), F.when(ending != "", ending))


STATS = "min double, avg double, max double, offers bigint, min_competitors bigint, avg_competitors bigint, updated_at bigint"


def stats_record(record: Column) -> Column:
    """A cached record of market statistics; fields that are missing or no numbers are null."""
    return F.from_json(record, STATS)


def normalized_map(values: Column, name: Column | None, rename, fallbacks: dict[str, str]) -> Column:
    """A map with its keys renamed (rename: column to column; blank ones go). Of keys that become one the one that was so named already stays, else the first in order; a fallback copies another key's value where its own is missing."""
    entries = F.filter(F.transform(F.map_entries(values), lambda e: F.struct(rename(e["key"]).alias("key"), (rename(e["key"]) != F.trim(e["key"])).alias("renamed"), e["key"].alias("old"), e["value"].alias("value"))), lambda e: F.coalesce(e["key"], F.lit("")) != "")
    ordered = F.array_sort(entries)
    firsts = F.filter(ordered, lambda e, i: (i == 0) | (F.get(ordered, i - 1)["key"] != e["key"]))
    plain = F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["key"], e["value"])))
    added = [F.map_filter(F.map_from_arrays(F.array(F.lit(to)), F.array(F.try_element_at(plain, F.lit(source)))), lambda k, v: v.isNotNull()) for to, source in fallbacks.items()]
    missing = lambda m, to: F.map_filter(m, lambda k, v: ~F.map_contains_key(plain, F.lit(to)))
    return reduce(F.map_concat, [missing(m, to) for m, to in zip(added, fallbacks, strict=True)], plain)
