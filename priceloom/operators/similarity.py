"""Joins of sets: by likeness with a prefix filter, the best few for each name, and by containment.

A prefix filter orders the tokens of all sets by how many sets hold them, rarest first. Two sets of an overlap (common tokens
over all tokens of both) of `least` or more share one of their first `size - ceil(least * size) + 1` tokens, so only those are
joined; sizes and the places of the common token rule out further pairs before the sets themselves are compared. A pair is
met at its first common token only, so nothing has to be made distinct. Frequent tokens are last in every set and seldom joined.

Null names and empty sets are in no pair. Repeated rows count once. Empty tables give empty results.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import text as X
from priceloom.sources.tables import discard, stored

#: Overlaps that best_overlaps() once went through, one after the other.
LEVELS = (0.75, 0.5, 0.34, 0.2, 0.1, 0.0)
#: Most names of items for a word to be rare, and most frequent words of a set whose subsets are looked up.
COMMON, DEEP = 64, 8
#: How many keys of a target a row is asked for at once, by the most keys that such a row has; rows with more are asked for one.
ASKED = ((12, 4), (40, 2))
#: About how many keys of equal sets are in one list, and most places (numbers of sets of keys) that are sent to every task.
LISTED, FEW = 1000, 1_000_000


def by_rarity(sets: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """key and tokens (array) with the tokens in order of `held` (token, n: in how many sets it is; tokens that are not there come first)."""
    rows = sets.select(key, F.explode("tokens").alias("token")).join(held, "token", "left")
    ordered = F.array_sort(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    return rows.groupBy(key).agg(ordered["token"].alias("tokens"))  # as many rows as a name has tokens


def token_sets(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """The distinct values of key with their tokens (array without repeats)."""
    return rows.select(key).filter(F.col(key).isNotNull()).distinct().select(key, F.array_distinct(F.array_compact(tokens)).alias("tokens"))


def frequencies(*sets: DataFrame) -> DataFrame:
    """token, n: in how many of all the sets each token is."""
    one = None
    for s in sets:
        tokens = s.select(F.explode("tokens").alias("token"))
        one = tokens if one is None else one.unionAll(tokens)
    return one.groupBy("token").agg(F.count("*").alias("n"))


def _begins(sets: DataFrame, key: str, side: str, least: float) -> DataFrame:
    """A row for each of the first tokens of a set, with its place from 0."""
    size = F.size("tokens")
    # ceil() of a product that should be whole must not be one too many.
    first = F.when(F.lit(least) > 0, size - F.ceil(size * least - 1e-9) + 1).otherwise(size).cast("int")
    return sets.select(key, F.col("tokens").alias(f"{side}_tokens"), F.posexplode(F.slice("tokens", 1, first)).alias(f"{side}_at", "token"))


def met(left: DataFrame, right: DataFrame, least: float, keys: tuple[str, str]) -> DataFrame:
    """The pairs that are left to be compared, once for each common token among the first of both."""
    a, b = _begins(left, keys[0], "a", least), _begins(right, keys[1], "b", least)
    a, b = a.withColumn("a_size", F.size("a_tokens")), b.withColumn("b_size", F.size("b_tokens"))
    sizes = F.col("a_size"), F.col("b_size")
    fits = (sizes[1] >= sizes[0] * least - 1e-9) & (sizes[0] >= sizes[1] * least - 1e-9)
    # What may still be common from the places of this token on.
    reach = 1 + F.least(sizes[0] - F.col("a_at") - 1, sizes[1] - F.col("b_at") - 1)
    fits &= reach >= (sizes[0] + sizes[1]) * (least / (1 + least)) - 1e-9
    # Sizes and places are judged once for all sets that have the token there, and are part of the key: sets that don't fit never meet.
    forms = a.join(b.select("token", "b_size", "b_at").distinct(), "token").filter(fits)
    return forms.join(b, ["token", "b_size", "b_at"]).select(*keys, "token", "a_tokens", "b_tokens")


def spread(sets: DataFrame) -> DataFrame:
    """Sets as a written table. They are few bytes and much work, so in as many files as a shuffle has partitions: many tasks read them."""
    return stored(sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def overlapping(left: DataFrame, right: DataFrame, least: float, keys: tuple[str, str] = ("product_name", "name")) -> DataFrame:
    """The two keys and overlap (four digits) of the pairs of sets, both given by by_rarity() with the same order, that reach `least` (0: that share a token)."""
    pairs = met(left, right, least, keys).withColumn("common", F.array_intersect("a_tokens", "b_tokens"))
    n = F.size("common")
    overlap = n / (F.size("a_tokens") + F.size("b_tokens") - n)
    return pairs.filter((F.col("token") == F.col("common")[0]) & (overlap >= least - 1e-9)).select(*keys, F.round(overlap, 4).alias("overlap"))


def _top(rows: DataFrame, keys: list[str], most: int, *first: Column) -> DataFrame:
    """The `most` rows of each key: by `first`, then those with the shorter and smaller id."""
    best = Window.partitionBy(*keys).orderBy(*first, F.length("product_id"), "product_id", "name")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def _subsets(array: str, most: int | None = None) -> Column:
    """All subsets of an array but the empty one, of `most` elements at most; each in the array's order."""
    small = lambda acc: acc if most is None else F.filter(acc, lambda x: F.size(x) < most)
    every = F.aggregate(array, F.array(F.array().cast("array<string>")), lambda acc, t: F.concat(acc, F.transform(small(acc), lambda x: F.concat(x, F.array(t)))))
    return F.filter(every, lambda x: F.size(x) > 0)


def of_both(n: Column, a: Column, b: Column) -> Column:
    """n common words over all words of sets of a and b words, with four digits."""
    return F.round(n / (a + b - n), 4)


def of_name(n: Column, a: Column, b: Column) -> Column:
    """n common words over the words of the name."""
    return n / a


def best_overlaps(names: DataFrame, items: DataFrame, most: int = 5, shortest: int = 2, levels: tuple[float, ...] = LEVELS, common: int = COMMON, deep: int = DEEP, score: Callable[[Column, Column, Column], Column] = of_both) -> DataFrame:
    """product_name, product_id, name, overlap, rank: of the items (product_id, name) that share a word with a name the `most` with the largest overlap.

    Of equal overlaps the shorter, then the smaller id comes first. Items of one name count by their ids, of which no more than
    `most` can matter.

    Items with a word that at most `common` of their names have are compared one by one. For the other words sets are classes:
    those with the same frequent words and the same number of words. Of items that hold the same frequent words only `most` can
    be among a name's best, so for each subset of frequent words, and each size, the first `most` items are kept, and a class of
    names looks up its own subsets. What that finds is a lower bound of the overlap, the overlap itself where no rare word is
    shared; an item left out has `most` before it. Classes with more than `deep` frequent words have too many subsets: they are
    held against the other classes. `levels` has no effect any more: no overlap has to be guessed. `score` says what the overlap
    is; it grows with the common words, and sets of the same sizes and common words have the same.
    """
    ids = stored(_top(items.filter("name IS NOT NULL").select("product_id", "name").distinct(), ["name"], most).drop("rank"))
    left = spread(token_sets(names, "product_name", X.words(F.col("product_name"), shortest)))
    right = spread(token_sets(ids, "name", X.words(F.col("name"), shortest)))
    own = left.select("product_name", F.size("tokens").alias("a_size"), F.explode("tokens").alias("token"))
    theirs = right.select("name", F.size("tokens").alias("b_size"), F.explode("tokens").alias("token"))
    held = stored(theirs.groupBy("token").agg(F.count("*").alias("n")).join(own.select("token").distinct(), "token", "left_semi"))
    rare, frequent = held.filter(F.col("n") <= common).select("token"), held.filter(F.col("n") > common).select("token")

    met_ = own.join(rare, "token").join(theirs, "token").select("product_name", "name").distinct()
    n = F.size(F.array_intersect("tokens", "others"))
    single = met_.join(left, "product_name").join(right.withColumnRenamed("tokens", "others"), "name")
    single = single.select("product_name", "name", score(n, F.size("tokens"), F.size("others")).alias("overlap")).join(ids, "name")

    classes = lambda rows, key, size: rows.join(frequent, "token").groupBy(key, size).agg(F.array_sort(F.collect_list("token")).alias("words"))
    of_names, of_items = stored(classes(own, "product_name", "a_size")), classes(theirs, "name", "b_size")
    kinds = stored(_top(of_items.join(ids, "name"), ["words", "b_size"], most).drop("rank"))
    asked = stored(of_names.select("words", "a_size").distinct())
    used = [ids, left, right, held, of_names, kinds, asked]

    short = F.size("words") <= deep
    first = stored(_top(kinds.filter(short).withColumn("subset", F.explode(_subsets("words"))), ["subset", "b_size"], most).select("subset", "b_size", "product_id", "name"))
    hits = asked.filter(short).withColumn("subset", F.explode(_subsets("words"))).join(first, "subset")
    found = hits.select("words", "a_size", "b_size", F.size("subset").alias("n"), "product_id", "name")
    used.append(first)
    if not (asked.filter(~short).isEmpty() and kinds.filter(~short).isEmpty()):
        others = kinds.select(F.col("words").alias("other"), "b_size", "product_id", "name")
        long = F.greatest(F.size("words"), F.size("other")) > deep
        pairs = asked.withColumn("token", F.explode("words")).join(others.withColumn("token", F.explode("other")), "token").filter(long & (F.col("token") == F.array_intersect("words", "other")[0]))
        found = found.unionByName(pairs.select("words", "a_size", "b_size", F.size(F.array_intersect("words", "other")).alias("n"), "product_id", "name"))
    overlap = score(F.col("n"), F.col("a_size"), F.col("b_size"))
    found = found.groupBy("words", "a_size", "product_id", "name").agg(F.max(overlap).alias("overlap"))
    shared = stored(_top(found, ["words", "a_size"], most, F.desc("overlap")).drop("rank"))
    used.append(shared)
    every = single.select("product_name", "product_id", "name", "overlap").unionByName(of_names.join(shared, ["words", "a_size"]).select("product_name", "product_id", "name", "overlap"))
    every = every.groupBy("product_name", "product_id", "name").agg(F.max("overlap").alias("overlap"))
    out = stored(_top(every, ["product_name"], most, F.desc("overlap")).select("product_name", "product_id", "name", "overlap", "rank"))
    discard(*used)
    return out


def _sets_of(rows: DataFrame, key: str) -> DataFrame:
    """key, keys (sorted, without repeats, not empty), several (whether the same key has other sets too); each set of a key once."""
    keys = F.array_sort(F.array_distinct(F.array_compact("keys")))
    sets = rows.select(key, keys.alias("keys")).filter(F.col(key).isNotNull() & (F.size("keys") > 0)).groupBy(key).agg(F.collect_set("keys").alias("sets"))
    return sets.select(key, (F.size("sets") > 1).alias("several"), F.explode("sets").alias("keys"))


def _lists(sets: DataFrame, key: str, name: str) -> DataFrame:
    """keys, several and name: the keys of equal sets as lists in order, each of some LISTED at most."""
    large = sets.groupBy("keys").agg(F.count("*").alias("n")).filter(F.col("n") > LISTED)
    block = F.coalesce(F.pmod(F.xxhash64(key), F.ceil(F.col("n") / LISTED)), F.lit(0))
    return sets.join(stored(large), "keys", "left").groupBy("keys", "several", block.alias("block")).agg(F.array_sort(F.collect_list(key)).alias(name)).drop("block")


def _bits(common: list) -> Column:
    """A number with a bit for each of the common keys (64 at most) that the set has."""
    bits = F.create_map(*[F.lit(x) for k, c in enumerate(common) for x in (c, (1 << k) - (1 << 64 if k == 63 else 0))])
    return F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, k).cast("long"), F.lit(0).cast("long"))))


def _signatures(keys: Column | str, most: int, sizes: list[int]) -> Column:
    """A number for each part of a set of so many keys (`sizes`, up to `most`); parts that differ may have the same."""
    none = F.array().cast("array<bigint>")
    first = F.array(F.array(F.lit(0).cast("long")), *[none] * most)
    longer = lambda acc, k: F.transform(acc, lambda part, i: F.when(i == 0, part).otherwise(F.concat(part, F.transform(F.get(acc, i - 1), lambda x: x.bitwiseXOR(F.xxhash64(k))))))
    return F.aggregate(keys, first, longer, lambda acc: F.array_distinct(F.concat(*[acc[s] for s in sizes])))


def containing(rows: DataFrame, targets: DataFrame, row: str = "row", target: str = "target") -> DataFrame:
    """The pairs (row, target) in which the row's keys (array) hold all keys of the target.

    Rows of equal keys are a list, and so are targets; only lists meet, and the pairs are made of them where they have met, so
    that no pair is ever shuffled. Targets are looked for under their rarest keys at once: four where the row has few keys, whose
    sets of four are few, two or one where it has more (ASKED). A list goes only where a target is asked. What is found is
    compared by a number with a bit for each of the 64 most frequent keys, and on the whole sets if there are more keys. A target
    that has no key, or one that no row has, is in no pair. Pairs of keys that have several sets are made distinct.
    """
    wanted, own = stored(_sets_of(targets, target)), stored(_sets_of(rows, row))
    used = [wanted, own]
    held = stored(own.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")))
    common = [r.key for r in held.orderBy(F.desc("n"), "key").limit(65).collect()]
    # With so few different keys their bits decide.
    sure, common = len(common) <= 64, common[:64]
    least = wanted.agg(F.min(F.size("keys"))).first()[0]
    if not common or least is None:
        discard(*used, held)
        return rows.select(row).crossJoin(targets.select(target)).filter(F.lit(False))
    # Sets are read by their distinct values from here on; sets too small for any target go.
    own_lists, of_targets = stored(_lists(own.filter(F.size("keys") >= least), row, "rows")), stored(_lists(wanted, target, "targets"))
    asked = of_targets.select("keys").distinct().select("keys", F.explode("keys").alias("key")).join(held, "key")
    rarest = asked.groupBy("keys").agg(F.array_sort(F.collect_list(F.struct("n", "key")))["key"].alias("rarest")).filter(F.size("rarest") == F.size("keys"))
    whole = [] if sure else ["keys"]
    wanted_lists = stored(of_targets.join(rarest, "keys").select(*whole, "several", "targets", "rarest", _bits(common).alias("bits")))
    largest = own_lists.agg(F.max(F.size("keys"))).first()[0] or 0
    doubled = not own.filter("several").isEmpty() or not wanted.filter("several").isEmpty()
    found, above = [], 0
    for size, many in (*ASKED, (None, 1)):
        some = own_lists.filter(F.size("keys") > above) if size is None else own_lists.filter((F.size("keys") > above) & (F.size("keys") <= size))
        part = F.slice("rarest", 1, many)
        signed = wanted_lists.select(F.aggregate(part, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.xxhash64(k))).alias("asked"), *[F.col(c).alias(f"b_{c}") for c in (*whole, "several", "bits")], "targets")
        # Sets of as many keys as targets are asked under; mostly that is one number.
        sizes = sorted(r[0] for r in wanted_lists.select(F.size(part)).distinct().collect())
        if largest > above and sizes:
            sets = some.select(*whole, "several", _bits(common).alias("bits"), "rows", F.explode(_signatures("keys", many, sizes)).alias("asked"))
            places = stored(signed.select("asked").distinct())
            if places.count() <= FEW:
                sets = sets.join(F.broadcast(places), "asked", "left_semi")
            # Lists are many times their table, by whose size Spark would broadcast it.
            pairs = sets.join(signed.hint("merge"), "asked").filter(F.col("bits").bitwiseAND(F.col("b_bits")) == F.col("b_bits"))
            found.append(pairs if sure else pairs.filter(F.size(F.array_except("b_keys", "keys")) == 0))
        above = size
    discard(*used, held, of_targets)
    if not found:
        return rows.select(row).crossJoin(targets.select(target)).filter(F.lit(False))
    made = lambda pairs: pairs.select(F.explode("rows").alias(row), "targets").select(row, F.explode("targets").alias(target))
    every = reduce(DataFrame.unionByName, found)
    if not doubled:
        return made(every)
    both = F.col("several") | F.col("b_several")
    return made(every.filter(~both)).unionByName(made(every.filter(both)).distinct())
