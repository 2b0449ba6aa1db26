"""Candidates within a product family in full: monitors and power supplies, by attributes read from names.

A family says what a name tells (a struct of attributes, blank where it says nothing), which pairs of names may be one product,
and what each agreement or conflict of a pair is worth. Pairs come from joins on equal attributes and, where one model may be
part of the other's, from the substring join; no name meets all others. `pool` gives scores of pairs that another search found,
which count where they are better. Scores have three digits and stay below 1; ties go to the smaller name in lower case, then
to the id. Null and blank names, and names that lack what the family needs, have no candidates.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import category_rules as rules
from priceloom.functions import models as D
from priceloom.operators import postings, similarity
from priceloom.sources.tables import discard, stored

# Scores of what is found in the catalog's names, the floor and the ceiling.
FOUND, FLOOR, CEILING = 0.91, 0.90, 0.999

# Makers of monitors and of power supplies, in order of precedence, and how names spell them.
MONITOR_MAKERS = ("elsa", "lg", "xiaomi", "asrock", "gigabyte", "msi", "asus", "aoc", "acer", "benq", "philips", "viewsonic", "samsung", "dell", "hp")
PSU_MAKERS = (
    ("1stplayer", r"1st\s*player"), ("adataxpg", "adata|xpg"), ("chieftec", "chieftec"), ("cougar", "cougar"), ("deepcool", "deepcool"), ("lianli", r"lian\s*li"),
    ("gamemax", "gamemax"), ("montech", "montech"), ("ntech", "n-?tech"), ("powercase", "powercase"), ("projectx", r"project\s*x"), ("vicsone", "vicsone"), ("zalman", "zalman"),
)
# Grades of power supplies, best first, and their cabling and series, first that fits.
GRADES = (("titanium", "titanium"), ("platinum", "platinum"), ("gold", "gold"), ("silver", "silver"), ("bronze", "bronze"), ("standard", r"standard|80\s*plus"))
CABLES = (("non", r"non[-\s]?modular|немодуль|не\s*модуль"), ("semi", r"semi[-\s]?modular|полу[-\s]?модуль"), ("full", r"full[-\s]?modular|полностью\s*модуль"))
PSU_SERIES = (
    ("ngdpgold", r"ngdp\s*gold"), ("ackbronze", r"ack\s*bronze"), ("ackgold", r"ack\s*gold"), ("dkpremium", r"dk\s*premium"), ("core_reactor_ii_ve", r"core\s*reactor\s*ii\s*ve"),
    ("core_reactor_ii", r"core\s*reactor\s*ii"), ("cyber_core_ii", r"cyber\s*core\s*ii"), ("pylonii", r"pylon\s*ii"), ("pylon", "@pylon@"), ("kyber", "@kyber@"), ("fusion", "@fusion@"),
    ("probe", "@probe@"), ("pymcore", "@pymcore@"), ("polarispro", r"polaris\s*pro"), ("polaris", "@polaris@"), ("core", "@core@"), ("proton", "@proton@"), ("gamerstorm", "@gamerstorm@"),
    ("centuryii", r"century\s*ii"), ("centuryg5", r"century\s*g5"), ("titangold", r"titan\s*gold"), ("titanpla", r"titan\s*pla"), ("fk", "@fk@"),
)
# What is no code of a power supply, what codes begin with, and what ends them without telling products apart.
NO_CODE = "atx atx20 atx23 atx24 atx30 atx31 nonmodular semimodular fullmodular modular activepfc apfc llcdc dcdc ret oem bulk".split()
NO_CODE_PARTS = "black|white|bronze|gold|silver|platinum|modular"
CODE_BEGINS = "ps ha pps ppx r zm pn pb vte sr".split()
CODE_ENDS = "bulk oem ret wgeu eu fa0b fc0b fc0w bk wh".split()


def alone(pattern: str) -> str:
    """The pattern between anything but Latin letters and digits."""
    return f"(?:^|[^a-z0-9])(?:{pattern})(?=$|[^a-z0-9])"


def first_that_fits(text: Column, patterns) -> Column:
    """The value of the first (value, pattern) whose pattern is found; blank if none is. @ stands for the border of a Latin word."""
    spelled = lambda p: p.replace("@", "", 1)[:-1] if p.startswith("@") else p
    found = [F.when(text.rlike(alone(spelled(p)) if p.startswith("@") else p), value) for value, p in patterns]
    return F.coalesce(*found, F.lit(""))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def mixed(code: Column, least: int) -> Column:
    """Whether a plain code is long enough and has letters and digits."""
    return (F.length(code) >= least) & code.rlike("[a-z]") & code.rlike("[0-9]")


def monitor(name: Column) -> Column:
    """brand, model (what follows the brand, up to a parenthesis), code (in parentheses, or beginning with P or ELA and a digit), size, resolution, hz, white."""
    clean = F.trim(F.translate(name, "″“”", '"""'))
    low = F.lower(clean)
    size = F.regexp_extract(clean, r'^\s*([0-9]{2}(?:\.[0-9])?)\s*"', 1)
    brand = first_that_fits(low, [(m, f"@{m}@") for m in MONITOR_MAKERS])
    rest = F.regexp_replace(low, r"(?U)^\s*(?:игровой\s+)?монитор\s+", "")
    rest = F.regexp_replace(rest, r'^\s*[0-9]{2}(?:\.[0-9])?\s*"\s*', "")
    rest = F.when((brand != "") & F.ltrim(rest).startswith(F.concat(brand, F.lit(" "))), F.substring(F.ltrim(rest), F.length(brand) + 2, F.length(rest))).otherwise(rest)
    codes = F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"\(([A-Za-z0-9][A-Za-z0-9\-]{4,40})\)")), plain), lambda t: mixed(t, 6))
    inline = plain(F.regexp_extract(clean, r"(?i)\b((?:p|ela)[0-9][A-Za-z0-9\-]{4,32})\b", 1))
    return F.struct(
        brand.alias("brand"),
        plain(F.element_at(F.split(rest, r"\s*\(", 2), 1)).alias("model"),
        F.coalesce(F.get(codes, F.lit(0)), inline).alias("code"),
        size.alias("size"),
        F.regexp_replace(F.regexp_extract(low, r"([0-9]{3,4}\s*x\s*[0-9]{3,4})", 1), r"\s+", "").alias("resolution"),
        F.regexp_extract(low, r"(?U)([0-9]{2,3})\s*(?:гц|hz)\b", 1).alias("hz"),
        low.rlike(alone("white") + "|бел").alias("white"),
    )


def psu_code(name: Column) -> Column:
    """The likeliest code: of words of parts joined by dashes and dots by how codes look, the shorter and first of equals; else one in parentheses."""
    strong = lambda t: mixed(t, 6) & ~t.isin(*NO_CODE) & ~t.startswith("atx")
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\b([A-Za-z0-9]{1,10}(?:[.-][A-Za-z0-9]{1,16}){1,6})\b"))

    def looks(word: Column) -> Column:
        parts, code = F.filter(F.split(word, "-+"), lambda p: p != ""), plain(word)
        points = lambda test, n: F.when(test, n).otherwise(0)
        begins = reduce(lambda a, b: a | b, [code.startswith(p) for p in CODE_BEGINS])
        return points((F.size(parts) >= 2) & (F.size(parts) <= 4), 20) + points(F.length(code) <= 18, 12) + points(begins, 18) + points(F.get(parts, F.lit(0)).rlike("[0-9]"), 6) - points(F.size(parts) >= 4, 6)

    good = F.filter(words, lambda w: strong(plain(w)) & ~plain(w).rlike(NO_CODE_PARTS))
    best = F.array_min(F.transform(good, lambda w, k: F.struct((-looks(w)).alias("a"), F.length(plain(w)).alias("b"), k.alias("k"), plain(w).alias("code"))))
    inner = F.filter(F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\(([A-Za-z0-9][A-Za-z0-9\-]{3,64})\)")), plain), strong)
    return F.coalesce(best["code"], F.get(inner, F.lit(0)), F.lit(""))


def psu(name: Column) -> Column:
    """brand, watt, grade, cables, code, series, form, atx (version), white, and bare: the code without its end."""
    low, code = F.lower(name), psu_code(name)
    return F.struct(
        first_that_fits(low, [(m, f"@{p}@") for m, p in PSU_MAKERS]).alias("brand"),
        F.regexp_extract(low, r"(?U)\b([0-9]{3,4})\s*(?:w|вт)\b", 1).alias("watt"),
        first_that_fits(low, [(g, rf"\b(?:{p})\b") for g, p in GRADES]).alias("grade"),
        first_that_fits(low, [(c, f"(?U){p}") for c, p in CABLES]).alias("cables"),
        code.alias("code"),
        first_that_fits(low, PSU_SERIES).alias("series"),
        F.when(low.rlike(alone("sfx")), "sfx").otherwise("atx").alias("form"),
        F.regexp_extract(low, r"\batx\s*([0-9](?:\.[0-9]{1,2})?)\b", 1).alias("atx"),
        low.rlike(rf"(?U){alone('white')}|\bбел(?:ый|ая|ое|ые)?\b").alias("white"),
        without_ends(code).alias("bare"),
    )


def without_ends(code: Column) -> Column:
    """A code without what ends it and tells no products apart; each ending goes once, in order."""
    cut = lambda left, end: F.when(F.endswith(left, end), F.substring(left, F.lit(1), F.length(left) - F.length(end))).otherwise(left)
    return F.aggregate(F.array(*map(F.lit, CODE_ENDS)), code, cut)


def same_code(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Whether two plain codes, x and y without their ends, stand for one product: equal with or without ends, one the beginning of the other, or within it."""
    begins = (F.least(F.length(x), F.length(y)) >= 6) & (x.startswith(y) | y.startswith(x))
    within = (F.least(F.length(x), F.length(y)) >= 8) & (x.contains(y) | y.contains(x))
    return (a != "") & (b != "") & ((a == b) | (x == y) | begins | within)


def _both(column: str, agree: float, conflict: float) -> Column:
    """What an attribute adds or takes where both names have it."""
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    return F.when((a == "") | (b == ""), 0.0).when(a == b, agree).otherwise(conflict)


def _near(column: str, most: float, agree: float, near: float, conflict: float) -> Column:
    """The same for numbers that may differ by `most`."""
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    apart = F.abs(a.try_cast("double") - b.try_cast("double"))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, agree).when(apart <= most, near).otherwise(conflict)


def _described(names: DataFrame, items: DataFrame, read: Callable[[Column], Column], category: str, infer: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """product_name and a; name and b; product_id and name. Written, so that attributes are read once from each name and not wherever they are asked for."""
    own = stored(names.select("product_name").filter(F.trim("product_name") != "").distinct())
    listed = stored(items.select("product_id", "name").filter(F.trim("name") != "").distinct())
    # Written before their kind is told, since Spark would filter all items and not their distinct names; in many files, so that many tasks tell it.
    called = similarity.spread(listed.select("name").distinct())
    left = stored(own.withColumn("a", read(F.col("product_name"))))
    of_kind = stored(called.filter(infer(F.col("name")) == category))
    right = stored(of_kind.withColumn("b", read(F.col("name"))))
    discard(own, called, of_kind)
    return left, right, listed


def _classes(right: DataFrame, listed: DataFrame, pool: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """class, name, b, n (its items); class, product_id, at (the item's place in its class).

    Items of one and the same name are a class; one of several names, or of the pool, is a class of its own.
    """
    items = listed.join(right.select("name"), "name", "left_semi")
    alone = items.groupBy("product_id").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    if pool is not None:
        alone = alone.join(pool.select("product_id").distinct().withColumn("pooled", F.lit(True)), "product_id", "left")
    shared = (F.col("name") == F.col("last")) & (F.lit(True) if pool is None else F.col("pooled").isNull())
    by_name = F.concat(F.lit("name:"), "name")
    classed = alone.select("product_id", F.when(shared, by_name).otherwise(_own_class()).alias("class"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("product_id"))
    members = stored(classed.withColumn("at", place))
    own = members.filter(F.col("class") == _own_class()).withColumnRenamed("product_id", "id")
    several = own.join(items, F.col("id").eqNullSafe(F.col("product_id"))).join(right, "name")
    held = right.select(by_name.alias("class"), "name", "b").unionByName(several.select("class", "name", "b"))
    return held.join(members.groupBy("class").agg(F.count("*").alias("n")), "class"), members


def _own_class() -> Column:
    return F.coalesce(F.concat(F.lit("id:"), "product_id"), F.lit("id"))


def _ranked(left: DataFrame, right: DataFrame, listed: DataFrame, pairs: DataFrame, score: Column, pool: DataFrame | None, most: int, narrowed: Column | None = None) -> DataFrame:
    """The candidates of names by pairs of attributes (a, b), best first. Where `narrowed` holds for a name's candidate, only such are shown.

    Classes of items are scored and ordered, and then get their items: a rank is the number of items in better classes and the place in the own one.
    """
    held, members = _classes(right, listed, pool)
    rows = left.join(pairs, "a").join(held, "b")
    if pool is not None:
        given = pool.groupBy("product_name", "product_id").agg(F.max("score").alias("given"))
        rows = rows.join(given.select("product_name", _own_class().alias("class"), "given"), ["product_name", "class"], "left")
    else:
        rows = rows.withColumn("given", F.lit(None).cast("double"))
    begun = F.greatest(F.lit(FOUND), F.coalesce("given", F.lit(FLOOR)))
    scored = rows.withColumn("score", begun).withColumn("score", F.round(F.least(F.lit(CEILING), F.greatest(F.lit(0.0), score)), 3))
    # Written, so that the long expressions of a score are in the plan once.
    scored = stored(scored.select("product_name", "class", "n", "name", "score", (F.lit(False) if narrowed is None else narrowed).alias("narrow")))
    one = scored.groupBy("product_name", "class", "n").agg(F.max_by(F.struct("name", "score", "narrow"), F.struct("score", "name")).alias("best"))
    best = one.select("product_name", "class", "n", "best.*", F.lower("best.name").alias("low"))
    best = best.withColumn("any", F.max("narrow").over(Window.partitionBy("product_name"))).filter(F.col("narrow") | ~F.col("any"))
    peers = Window.partitionBy("product_name", "score", "low")
    # Up to and with those of the same score and name in lower case.
    upto = F.sum("n").over(Window.partitionBy("product_name").orderBy(F.desc("score"), "low"))
    best = best.withColumn("better", upto - F.sum("n").over(peers)).withColumn("tied", F.count("*").over(peers) > 1).filter(F.col("better") < most)
    best = stored(best.select("product_name", "class", "name", "score", "low", "better", "tied"))
    discard(scored)
    # Items of classes that are level are ordered among each other.
    found = best.join(members.filter(F.col("at") <= most), "class")
    level = found.filter("tied").withColumn("at", F.row_number().over(peers.orderBy("product_id")))
    out = found.filter("NOT tied").unionByName(level).withColumn("rank", F.col("better") + F.col("at")).filter(F.col("rank") <= most)
    return out.select("product_name", "product_id", "name", "score", F.col("rank").cast("int").alias("rank"))


def monitor_candidates(names: DataFrame, items: DataFrame, most: int = 5, pool: DataFrame | None = None, infer: Callable[[Column], Column] = rules.category) -> DataFrame:
    """product_name, product_id, name, score, rank: monitors of one maker with the same code, the same model, or one model within the other."""
    known, described, listed = _described(names, items, monitor, "Монитор", infer)
    left, right = known.select("a").distinct().filter((F.col("a.brand") != "") & (F.col("a.model") != "")), described.select("b").distinct()
    coded = left.join(right, (F.col("a.brand") == F.col("b.brand")) & (F.col("a.code") == F.col("b.code")) & (F.col("a.code") != ""))
    # Makers go before the models, so that a model is looked for among those of its maker only.
    spelled = lambda d: F.concat(F.col(f"{d}.brand"), F.lit(":"), F.col(f"{d}.model"))
    mine, theirs = (d.select(F.col(f"{s}.brand").alias("brand"), F.col(f"{s}.model").alias("model")).filter("model <> ''").distinct() for d, s in ((left, "a"), (right, "b")))

    def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
        """brand, model of inner, model of outer that holds it."""
        found = postings.names_with(inner.select(F.col("model").alias("needle")), postings.trigram_index(outer.select(F.col("model").alias("name")), 1), 1)
        return found.join(inner.select("brand", F.col("model").alias("needle")), "needle").join(outer.select("brand", F.col("model").alias("name")), ["brand", "name"])

    models = within(mine, theirs).select("brand", F.col("needle").alias("x"), F.col("name").alias("y"))
    models = models.union(within(theirs, mine).select("brand", F.col("name").alias("x"), F.col("needle").alias("y"))).distinct()
    close = left.withColumn("key", spelled("a")).join(models.select(F.concat("brand", F.lit(":"), "x").alias("key"), F.concat("brand", F.lit(":"), "y").alias("other")), "key")
    close = close.join(right.withColumn("other", spelled("b")), "other").drop("key", "other")
    pairs = coded.unionByName(close).distinct()
    code = (F.col("a.code") != "") & (F.col("a.code") == F.col("b.code"))
    score = F.when(code, F.greatest("score", F.lit(0.97)) + 0.05).otherwise(F.col("score"))
    score += F.when(F.col("a.model") == F.col("b.model"), 0.07).when((F.col("b.model") != "") & (F.col("a.model").contains(F.col("b.model")) | F.col("b.model").contains(F.col("a.model"))), 0.04).otherwise(0.0)
    score += _both("size", 0.03, -0.10) + _both("resolution", 0.03, -0.10) + _near("hz", 20, 0.03, 0.005, -0.07)
    score += F.when(F.col("a.white") != F.col("b.white"), -0.05).otherwise(0.0)
    out = _ranked(known, described, listed, pairs, score, pool, most)
    discard(known, described, listed)
    return out


def psu_candidates(names: DataFrame, items: DataFrame, most: int = 5, pool: DataFrame | None = None, infer: Callable[[Column], Column] = rules.category) -> DataFrame:
    """product_name, product_id, name, score, rank: power supplies of one maker that no attribute tells apart; of a name whose code some candidate has, only such."""
    known, described, listed = _described(names, items, psu, "Блок питания", infer)
    left, right = known.select("a").distinct().filter((F.col("a.brand") != "") & (F.col("a.watt") != "")), described.select("b").distinct()
    # A catalog name that doesn't say its power fits any. Every name has a form.
    asked = left.withColumn("watt", F.explode(F.array(F.col("a.watt"), F.lit(""))))
    pairs = asked.join(right, (F.col("a.brand") == F.col("b.brand")) & (F.col("a.form") == F.col("b.form")) & (F.col("watt") == F.col("b.watt"))).drop("watt")
    apart = [(F.col(f"a.{c}") != "") & (F.col(f"b.{c}") != "") & (F.col(f"a.{c}") != F.col(f"b.{c}")) for c in ("grade", "cables")]
    code, coded = same_code(F.col("a.code"), F.col("b.code"), F.col("a.bare"), F.col("b.bare")), (F.col("a.code") != "") & (F.col("b.code") != "")
    pairs = pairs.filter(~reduce(lambda a, b: a | b, apart) & (~coded | code))
    score = F.when(code, F.lit(CEILING)).otherwise(F.col("score")) + _both("series", 0.05, -0.08) + _near("atx", 0.11, 0.015, 0.015, -0.05)
    score += F.when(F.col("a.white") != F.col("b.white"), -0.05).otherwise(0.0)
    out = _ranked(known, described, listed, pairs, score, pool, most, code)
    discard(known, described, listed)
    return out
