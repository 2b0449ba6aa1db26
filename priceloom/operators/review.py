"""Review work: queue entries against current offers, replacement candidates, candidates within a product family."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import category_rules as rules
from priceloom.functions import text as X
from priceloom.operators import matcher, matching
from priceloom.sources.tables import stored

#: Reasons of match_names under which a candidate is out of the question.
HARD_REASONS = (
    "no_name", "strict_article_conflict", "model_variant_conflict", "numeric_article_conflict", "tgpc_code_mismatch", "tgpc_gpu_mismatch",
    "motherboard_brand_mismatch", "motherboard_model_mismatch", "apple_article_conflict", "article_conflict", "category_mismatch",
)


def open_entries(queue: DataFrame, offers: DataFrame) -> DataFrame:
    """The queue's entries (name_key, supplier, added) with the place `pos` of their last offer, newest first.

    An entry goes once the last offer of that name and supplier has an id. An entry without a supplier takes the last
    offer of the name from anyone; one without an offer stays, its pos null.
    """
    named = offers.select(X.name_key(F.col("product_name")).alias("name_key"), "supplier", "pos", F.col("product_id").isNotNull().alias("has_id"))
    last = lambda *keys: named.groupBy(*keys).agg(F.max_by(F.struct("pos", "has_id"), "pos").alias("offer"))
    own = queue.filter("supplier IS NOT NULL").join(last("name_key", "supplier"), ["name_key", "supplier"], "left")
    anyone = queue.filter("supplier IS NULL").join(last("name_key"), "name_key", "left")
    rows = own.unionByName(anyone).filter(~F.coalesce("offer.has_id", F.lit(False)))
    return rows.select("name_key", "supplier", "added", F.col("offer.pos").alias("pos")).orderBy(F.desc("added"), "name_key", "supplier")


def replacements(pairs: DataFrame, most: int = 80, items: DataFrame | None = None) -> DataFrame:
    """Of pairs (product_name, product_id, name, score) the best per name, `most` at most. With items (product_id, name) the pairs are
    of names only, and names get their ids once they are judged: of ids with one name only the first `most` can be among the best.

    Pairs with a hard conflict go. Where the names match, 0.85 of that match and 0.15 of the score given are the new
    score; else the score given stays. Of equal scores the smaller id comes first.
    """
    given = pairs.select("product_name", *["product_id"] * (items is None), "name", F.col("score").alias("given"))
    held = matcher.match_names(given).filter(~F.col("reason").isin(*HARD_REASONS))
    score = F.round(F.when(F.col("match"), 0.85 * F.col("score") + 0.15 * F.col("given")).otherwise(F.col("given")), 3)
    held = held.withColumn("score", score)
    if items is not None:
        # Written, so that Spark knows how small the judged names are beside the items.
        held = stored(held).join(matching.first_ids(items, most), "name")
    one = held.groupBy("product_name", "product_id").agg(F.max_by(F.struct("name", "score", "reason"), F.struct("score", "name")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("product_name").orderBy(F.desc("best.score"), "product_id"))
    return one.select("product_name", "product_id", "best.*", rank.alias("rank")).filter(F.col("rank") <= most)


@dataclass(frozen=True)
class Family:
    """Products of one kind. Names fulfil `kind`; candidates share every attribute of `same`; each attribute of `near`
    (pattern, gain, loss) adds or takes where both names have it. A pattern's first group is the attribute. Each pattern of
    `parity` is found in both names or in neither."""

    kind: str
    same: dict[str, str]
    near: dict[str, tuple[str, float, float]] = field(default_factory=dict)
    base: float = 0.90
    parity: tuple[str, ...] = ()


_BRANDS = r"\b(a4tech|acer|adata|aerocool|amd|aoc|arctic|asrock|asus|be quiet|benq|biostar|brother|canon|chieftec|cooler master|corsair|crucial|deepcool|dell|epson|fractal|g\.?skill|gigabyte|hp|inno3d|intel|kingston|lexmark|lg|logitech|msi|nzxt|palit|pantum|patriot|philips|powercolor|razer|ricoh|samsung|sapphire|seagate|seasonic|team|thermaltake|toshiba|viewsonic|wd|western digital|xerox|xpg|zotac)\b"
_COLOUR = (r"\b(black|white|silver|grey|red|blue)\b", 0.01, 0.05)
_SIZE = r"\b([0-9]+ ?(?:gb|tb))\b"

# The built-in families, their gains, losses and bases. Attributes are compared in lower case without spaces.
FAMILIES = {
    "cpu": Family(r"\b(?:ryzen|core i[3579]|core ultra|athlon|pentium|celeron|xeon|threadripper)\b", {"model": r"\b((?:i[3579]-|ryzen [3579] (?:pro )?|ultra [579] )?[0-9]{3,5}[a-z]{0,3}[0-9]?)\b"}, {"package": (r"\b(box|oem|tray|mpk)\b", 0.03, 0.12)}, 0.94),
    "board": Family(r"\b(?:motherboard|[abhxz][0-9]{3}[a-z]*)\b", {"brand": _BRANDS, "chipset": r"\b([abhxz][0-9]{3})[a-z]*\b"}, {"memory": (r"\b(ddr[345]|d[45])\b", 0.02, 0.10), "form": (r"\b(e-?atx|micro-?atx|m-?atx|mini-?itx|atx|itx)\b", 0.02, 0.08)}, parity=(r"wi-?fi",)),
    "monitor": Family(r"\b(?:monitor|display)\b", {"brand": _BRANDS, "code": r"\b([a-z]{0,4}[0-9]{2}[a-z0-9]{2,}[a-z0-9-]*)\b"}, {"size": (r"([0-9]{2}(?:\.[0-9])?)(?:\"|''| inch)", 0.03, 0.10), "rate": (r"\b([0-9]{2,3}) ?hz\b", 0.02, 0.05), "colour": _COLOUR}),
    "gpu": Family(r"\b(?:rtx|gtx|geforce|radeon|rx|arc)\b", {"brand": _BRANDS, "model": r"\b((?:rtx|gtx|rx|arc) ?[ab]?[0-9]{3,4}(?: ?(?:ti super|ti|super|xtx|xt|gre))?)\b"}, {"memory": (_SIZE, 0.04, 0.12), "clock": (r"\b(oc)\b", 0.02, 0.02), "colour": _COLOUR}),
    "ram": Family(r"\bddr[2345]\b", {"brand": _BRANDS, "kind": r"\b(ddr[2345])\b"}, {"capacity": (r"\b((?:[0-9]x)?[0-9]+ ?gb)\b", 0.04, 0.20), "speed": (r"\b([0-9]{4}) ?(?:mhz|mt/s)", 0.03, 0.10), "latency": (r"\b(cl[0-9]{2})\b", 0.02, 0.06)}),
    "ssd": Family(r"\bssd\b", {"brand": _BRANDS}, {"capacity": (_SIZE, 0.07, 0.30), "code": (r"\b([a-z0-9]{2,}[0-9][a-z0-9]*/[a-z0-9]+|[a-z]{2}-?[a-z0-9]{6,})\b", 0.10, 0.30), "place": (r"\b(external|portable)\b", 0.0, 0.08)}, 0.82),
    "psu": Family(r"\b(?:psu|power supply|[0-9]{3,4} ?w)\b", {"brand": _BRANDS, "power": r"([0-9]{3,4}) ?w?\b"}, {"grade": (r"\b(bronze|silver|gold|platinum|titanium)\b", 0.04, 0.20), "form": (r"\b(sfx-l|sfx|tfx|atx)\b", 0.01, 0.20)}),
    "case": Family(r"\b(?:case|tower|chassis)\b", {"brand": _BRANDS}, {"code": (r"\b([a-z]{1,4}-?[0-9]{2,5}[a-z0-9-]*)\b", 0.10, 0.30), "colour": _COLOUR}, 0.88),
    "hdd": Family(r"\b(?:hdd|hard drive)\b", {"brand": _BRANDS, "capacity": _SIZE}, {"code": (r"\b([a-z]{2}[0-9]{2,}[a-z0-9-]+)\b", 0.11, 0.30), "form": (r"\b([23]\.5)\b", 0.01, 0.20)}, 0.88),
    "printer": Family(r"\b(?:printer|mfp|laserjet|deskjet|ecotank|pixma)\b", {"brand": _BRANDS, "model": r"\b([a-z]{0,4}-?[0-9]{3,5}[a-z]{0,4})\b"}, {"colour": _COLOUR}, 0.95),
    "cooler": Family(r"\b(?:cooler|heatsink|aio|liquid)\b", {"brand": _BRANDS}, {"code": (r"\b([a-z]{1,3}-?[0-9]{2,4}[a-z]*)\b", 0.10, 0.30), "colour": _COLOUR}, 0.88, (r"\b(?:liquid|aio|water)\b",)),
}


#: Categories of peripherals.
PERIPHERALS = ("Клавиатура", "Мышь", "Наушники", "Акустика")


def peripheral_candidates(names: DataFrame, items: DataFrame, least: float = 0.25, most: int = 5) -> DataFrame:
    """product_name, product_id, score, rank: of the items (product_id, name) that are peripherals by their names, those that share a token with a name and match it by `least` or more; an equal name scores 1, others 0.999 at most."""
    # Written: the rules are long, and the pairs read the items several times.
    kinds = stored(items.select("name").distinct().withColumn("kind", rules.category(F.col("name"))))
    own = stored(items.select("product_id", "name").distinct().join(kinds.filter(F.col("kind").isin(*PERIPHERALS)).select("name"), "name", "left_semi"))
    judged = matcher.match_names(matching.named_pairs(names, own).select("product_name", "name"), least)
    score = F.when(X.name_key(F.col("product_name")) == X.name_key(F.col("name")), 1.0).otherwise(F.least(F.lit(0.999), F.col("score")))
    scored = stored(judged.select("product_name", "name", F.round(score, 3).alias("score")).filter(F.col("score") >= least))
    # Of items with one name, which score alike, the smaller ids come first: no more than `most` can be among a name's best.
    scored = scored.join(matching.first_ids(own, most), "name")
    rank = F.row_number().over(Window.partitionBy("product_name").orderBy(F.desc("score"), F.lower("name"), "product_id"))
    return scored.select("product_name", "product_id", "score", rank.alias("rank")).filter(F.col("rank") <= most)


def attribute(name: Column, pattern: str) -> Column:
    """The first group of the pattern in the name, without spaces and dashes; null where the pattern isn't found."""
    low = F.lower(name)
    return F.when(low.rlike(pattern), F.regexp_replace(F.regexp_extract(low, pattern, 1), "[ -]", ""))


def family_candidates(names: DataFrame, items: DataFrame, family: Family, most: int = 5) -> DataFrame:
    """product_name, product_id, score, rank: for each distinct name of the family, items that share its `same`.

    Equal names score 1, others at most 0.999. The join is on the shared attributes; names that lack one get nothing.
    """
    def described(rows: DataFrame, name: str, side: str) -> DataFrame:
        of = rows.filter(F.lower(name).rlike(family.kind))
        same = {f"same_{k}": attribute(F.col(name), pattern) for k, pattern in family.same.items()}
        same |= {f"same_parity{k}": F.lower(name).rlike(pattern) for k, pattern in enumerate(family.parity)}
        return of.withColumns(same | {f"{side}_{k}": attribute(F.col(name), pattern) for k, (pattern, _, _) in family.near.items()})

    left = described(names.select("product_name").distinct(), "product_name", "a")
    right = described(items.select("product_id", "name").distinct(), "name", "b")
    score = F.lit(family.base)
    for k, (_, gain, loss) in family.near.items():
        a, b = F.col(f"a_{k}"), F.col(f"b_{k}")
        score = score + F.when(a == b, gain).when(a != b, -loss).otherwise(0.0)
    score = F.when(X.name_key(F.col("product_name")) == X.name_key(F.col("name")), 1.0).otherwise(F.least(F.lit(0.999), score))
    shared = [c for c in left.columns if c.startswith("same_")]
    pairs = left.join(right, shared).groupBy("product_name", "product_id").agg(F.round(F.max(score), 3).alias("score"))
    rank = F.row_number().over(Window.partitionBy("product_name").orderBy(F.desc("score"), F.length("product_id"), "product_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= most)
