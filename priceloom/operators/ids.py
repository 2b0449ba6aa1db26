"""Work on ids: reports, verification, missing ids, conflicts, manual decisions, and resolving offers without an id."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceloom.functions import models as D
from priceloom.functions import text as X
from priceloom.operators import catalog as C
from priceloom.operators import matcher
from priceloom.operators import matching as N
from priceloom.operators.similarity import spread
from priceloom.sources.tables import stored

#: Scores below which an id has to be looked at, and is cleared.
REVIEW, CLEAR = 0.74, 0.65


def _scored(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """The offers with an id, with catalog_name and the verdict on both names; each distinct pair of names is judged once."""
    rows = offers.filter("product_id IS NOT NULL").join(catalog.select("product_id", F.col("name").alias("catalog_name")), "product_id", "left")
    pairs = rows.filter("catalog_name IS NOT NULL").select("product_name", F.col("catalog_name").alias("name")).distinct()
    judged = matcher.match_names(pairs).select(F.col("product_name").alias("own_name"), F.col("name").alias("other_name"), "score", "match", "reason")
    return rows.join(judged, F.col("product_name").eqNullSafe(F.col("own_name")) & (F.col("catalog_name") == F.col("other_name")), "left").drop("own_name", "other_name")


def compare_report(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every offer with an id: the catalog's name, likeness in percent and decision (missing, check below 74, or ok)."""
    rows = _scored(offers, catalog).withColumn("percent", F.round(F.col("score") * 100, 1))
    decision = F.when(F.col("catalog_name").isNull(), "missing").when(F.col("percent") < 100 * REVIEW, "check").otherwise("ok")
    return rows.select("product_id", "supplier", "product_name", "catalog_name", "category", "price", "percent", "reason", decision.alias("decision"))


def verify(offers: DataFrame, catalog: DataFrame, confirmed: DataFrame, least: float = REVIEW) -> DataFrame:
    """Every offer with an id: match (confirmed by hand, or names that match), mismatch, or review where the catalog has no name. confirmed: product_id, name_key."""
    rows = _scored(offers, catalog).withColumn("name_key", X.name_key(F.col("product_name")))
    rows = rows.join(confirmed.select("product_id", "name_key", F.lit(True).alias("by_hand")).distinct(), ["product_id", "name_key"], "left")
    by_hand, known = F.coalesce("by_hand", F.lit(False)), F.col("catalog_name").isNotNull()
    status = F.when(by_hand, "match").when(~known, "review").when(F.col("match") | (F.col("score") >= least), "match").otherwise("mismatch")
    score = F.when(by_hand, 1.0).when(known, F.col("score")).otherwise(0.0)
    reason = F.when(by_hand, "manual_confirmed").when(known, F.col("reason")).otherwise("api_no_name")
    return rows.select("supplier", "supplier_code", "product_id", "product_name", score.alias("score"), reason.alias("reason"), status.alias("status"))


def by_status(results: DataFrame) -> DataFrame:
    """Verification results in the order in which they are worked on: mismatch, review, match; then score and name."""
    place = F.array_position(F.array(*map(F.lit, ("mismatch", "review", "match"))), F.col("status"))
    return results.orderBy(place, "score", "product_name")


def validate_clean(offers: DataFrame, catalog: DataFrame, confirmed: DataFrame, least: float = CLEAR) -> DataFrame:
    """Every offer with an id and a decision: confirm (by hand, or 0.65 and more), clear (names differ, no such product, or the exact name has another id), or skip without a name."""
    rows = _scored(offers, catalog).withColumn("name_key", X.name_key(F.col("product_name")))
    rows = rows.join(confirmed.select("product_id", "name_key", F.lit(True).alias("by_hand")).distinct(), ["product_id", "name_key"], "left")
    rows = rows.join(C.name_index(catalog), "name_key", "left")
    decision = (
        F.when(F.coalesce("by_hand", F.lit(False)), "confirm").when(F.coalesce(X.strip(F.col("product_name")), F.lit("")) == "", "skip").when(F.col("catalog_name").isNull(), "clear")
        .when(F.col("found_id") == F.col("product_id"), "confirm").when(F.col("found_id").isNotNull(), "clear").when(F.col("score") >= least, "confirm").otherwise("clear")
    )
    return rows.select("supplier", "supplier_code", "product_id", "product_name", decision.alias("decision"))


def validation_tasks(offers: DataFrame, is_assembled: Column) -> tuple[DataFrame, DataFrame]:
    """The offers with an id and a name that are no assembled computers; and how many were taken and skipped."""
    with_id = offers.filter(F.col("product_id").isNotNull() & (F.coalesce(X.strip(F.col("product_name")), F.lit("")) != ""))
    skipped = F.coalesce(is_assembled, F.lit(False))
    counts = with_id.agg(F.count_if(~skipped).alias("n_tasks"), F.count_if(skipped).alias("n_skipped"))
    return with_id.filter(~skipped), counts


def find_missing(offers: DataFrame, cache: DataFrame, catalog: DataFrame, known_missing: DataFrame) -> DataFrame:
    """key, product_name, found_id: offers (key, product_name) without an id whose key the trusted cache (key, product_id) and the negative one (key) lack, with the id of their unique token."""
    asked = offers.filter("product_id IS NULL AND key IS NOT NULL").groupBy("key").agg(F.min("product_name").alias("product_name"))
    fresh = asked.join(cache.filter("product_id IS NOT NULL"), "key", "left_anti").join(known_missing, "key", "left_anti")
    return fresh.join(C.unique_token_ids(fresh, catalog).select("product_name", "found_id"), "product_name", "left").select("key", "product_name", "found_id")


def known_ids(sources: list[DataFrame], most: int | None = None) -> DataFrame:
    """product_id, source: the distinct ids of the sources (product_id, pos), the first source of each; with `most` the first so many in their order."""
    rows = [s.select("product_id", "pos", F.lit(k).alias("source")) for k, s in enumerate(sources)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    first = every.filter("product_id IS NOT NULL").groupBy("product_id").agg(F.min(F.struct("source", "pos")).alias("first"))
    if most is not None:
        first = first.orderBy("first", "product_id").limit(most)
    return first.select("product_id", "first.source")


def conflicts(offers: DataFrame) -> DataFrame:
    """product_id, supplier, one, other: pairs of names of a supplier under one id that share no model token.

    Names are compared by their keys, and only those that have the same id and supplier meet, distinct names once.
    """
    names = offers.filter("product_id IS NOT NULL").select("product_id", "supplier", X.name_key(F.col("product_name")).alias("one")).distinct()
    models = names.select("one").distinct().withColumn("models", F.filter(D.model_hints(F.col("one")), lambda t: F.length(t) >= 4))
    names = names.join(models, "one")
    others = names.select("product_id", "supplier", F.col("one").alias("other"), F.col("models").alias("others"))
    return names.join(others, ["product_id", "supplier"]).filter((F.col("one") < F.col("other")) & ~F.arrays_overlap("models", "others")).select("product_id", "supplier", "one", "other")


def decide(bindings: DataFrame, decisions: DataFrame) -> DataFrame:
    """bindings (supplier, name_key, bound_id, blocked, at) after the decisions (also action: confirm, clear or reject): the last of each supplier and name holds; reject blocks the id, clear forgets."""
    made = decisions.select("supplier", "name_key", F.when(F.col("action") == "confirm", F.col("bound_id")).alias("bound_id"), (F.col("action") == "reject").alias("blocked"), "at", (F.col("action") == "clear").alias("gone"))
    every = bindings.select("supplier", "name_key", "bound_id", "blocked", "at", F.lit(False).alias("gone")).unionByName(made)
    last = every.groupBy("supplier", "name_key").agg(F.max_by(F.struct("bound_id", "blocked", "at", "gone"), F.struct("at", "gone", "blocked", "bound_id")).alias("last"))
    return last.filter("NOT last.gone").select("supplier", "name_key", "last.bound_id", "last.blocked", "last.at")


def tasks(offers: DataFrame) -> DataFrame:
    """item_key, supplier, name_key, product_name, category, occurrences: the offers without an id, one for each supplier and name key: the first, and how many there are."""
    rows = offers.filter(F.col("product_id").isNull() & (F.coalesce(X.strip(F.col("product_name")), F.lit("")) != "")).withColumn("name_key", X.name_key(F.col("product_name")))
    key = F.substring(F.sha1(F.concat(F.lower("supplier"), F.lit("\n"), F.col("name_key"))), 1, 24)
    rows = rows.filter("name_key <> ''").groupBy(key.alias("item_key")).agg(F.min_by(F.struct("supplier", "name_key", "product_name", "category"), "pos").alias("first"), F.count("*").alias("occurrences"))
    return rows.select("item_key", "first.*", "occurrences")


def _pairs(names: DataFrame, catalog: DataFrame, least: float) -> DataFrame:
    """product_name, product_id, name: the pairs that share a token and may score `least` or more.

    Two names with strict articles, none in common, score matcher.STRICT_APART whatever else they say, so above that score
    names with articles meet the items that have one of these, and the items that have none.
    """
    if least <= matcher.STRICT_APART:
        return N.token_candidates(names, catalog).select("product_name", "product_id", "name")
    a = stored(spread(names.select("product_name").distinct()).withColumn("strict", D.strict_articles(F.col("product_name"))))
    b = stored(spread(catalog.select("product_id", "name").distinct()).withColumn("strict", D.strict_articles(F.col("name"))))
    some = F.size("strict") > 0
    one, other = (x.filter(some).withColumn("article", F.explode("strict")).drop("strict") for x in (a, b))
    words = [X.words(F.col(c)) for c in ("product_name", "name")]
    same = one.join(other, "article").filter(F.arrays_overlap(*words)).select("product_name", "product_id", "name").distinct()
    bare = F.coalesce(~some, F.lit(True))
    rest = [N.token_candidates(a.filter(some), b.filter(bare)), N.token_candidates(a.filter(bare), b)]
    return reduce(DataFrame.unionByName, [r.select("product_name", "product_id", "name") for r in rest], same)


def resolve(items: DataFrame, catalog: DataFrame, rejections: DataFrame, most: int = 5, least: float = 0.18) -> DataFrame:
    """Tasks (item_key, supplier, name_key, product_name) with their best id, score, lead and tier.

    A name that the catalog has exactly takes its id; others take the best of their `most` candidates that share a token and
    score `least` or more. Rejected ids (supplier, name_key, product_id) do not count.
    """
    exact = C.name_index(catalog)
    names = items.select("name_key", "product_name").distinct()
    hit = names.join(exact, "name_key").select("product_name", F.col("found_id").alias("product_id"), F.lit(1.0).alias("score"), F.lit("exact_name").alias("reason"), F.lit(True).alias("exact"))
    rest = names.join(exact, "name_key", "left_anti").select("product_name")
    pairs = stored(_pairs(rest, catalog, least))
    judged = matcher.match_names(pairs.select("product_name", "name").distinct(), least)
    scored = pairs.join(judged, ["product_name", "name"]).select("product_name", "product_id", "score", "reason", F.lit(False).alias("exact"))
    found = hit.unionByName(N.top_candidates(scored, F.col("score"), most).drop("rank"))
    gone = rejections.select(F.lower("supplier").alias("low"), "name_key", "product_id", F.lit(True).alias("no")).distinct()
    mine = items.select("item_key", "name_key", "product_name", F.lower("supplier").alias("low")).join(found, "product_name").join(gone, ["low", "name_key", "product_id"], "left")
    mine = mine.select(F.col("item_key").alias("product_name"), "product_id", "score", "reason", "exact", F.coalesce("no", F.lit(False)).alias("rejected"))
    tier = N.tiers(mine, "score").withColumnRenamed("product_name", "item_key")
    best = mine.filter("NOT rejected").groupBy("product_name").agg(F.min_by("product_id", F.struct(-F.col("score"), F.length("product_id"), "product_id")).alias("best_id")).withColumnRenamed("product_name", "item_key")
    return items.join(tier, "item_key", "left").join(best, "item_key", "left").select("item_key", "supplier", "product_name", "best_id", F.coalesce("top", F.lit(0.0)).alias("score"), F.coalesce("lead", F.lit(0.0)).alias("lead"), F.coalesce("tier", F.lit("none")).alias("tier"))


def scan(offers: DataFrame, in_scope: Column, queue: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries that a review scan adds to the queue (name_key, supplier), and its counts.

    Offers without an id in scope count as scanned; entries that the queue has are skipped, those whose name is not in found
    (product_name) have no candidates, the others are queued, once for each name and supplier.
    """
    rows = offers.filter(F.col("product_id").isNull() & F.coalesce(in_scope, F.lit(False))).select("supplier", "product_name", X.name_key(F.col("product_name")).alias("name_key"))
    items = rows.groupBy("supplier", "name_key").agg(F.min("product_name").alias("product_name"), F.count("*").alias("n"))
    items = items.join(queue.select("supplier", "name_key", F.lit(True).alias("queued")).distinct(), ["supplier", "name_key"], "left")
    items = items.join(found.select("product_name", F.lit(True).alias("found")).distinct(), "product_name", "left")
    state = F.when(F.coalesce("queued", F.lit(False)), "skipped").when(F.coalesce("found", F.lit(False)), "queued").otherwise("no_candidates")
    items = items.withColumn("state", state)
    counts = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), *[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "no_candidates", "skipped")])
    return items.filter("state = 'queued'").select("supplier", "name_key", "product_name"), counts


def move_entries(queue: DataFrame, picked: DataFrame, renamed: DataFrame) -> DataFrame:
    """The queue (name_key, supplier, added) without the picked entries (name_key, supplier; a null supplier picks everyone's), under the new supplier names (supplier, new_supplier); of entries that become one the older stays."""
    own, every = picked.filter("supplier IS NOT NULL").select("name_key", "supplier"), picked.filter("supplier IS NULL").select("name_key")
    left = queue.join(own, ["name_key", "supplier"], "left_anti").join(every, "name_key", "left_anti")
    moved = left.join(renamed, "supplier", "left").select("name_key", F.coalesce("new_supplier", "supplier").alias("supplier"), "added")
    return moved.groupBy("name_key", "supplier").agg(F.min("added").alias("added"))


def autosort(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (with an array `keys`) with `chosen`: the target of the keys (key, target) that a row has, the least where several apply."""
    keyed = rows.select("keys").distinct().select("keys", F.explode("keys").alias("key")).join(targets, "key").groupBy("keys").agg(F.min("target").alias("chosen"))
    return rows.join(keyed, "keys", "left")


def apply_override(rows: DataFrame, overrides: DataFrame, keys: DataFrame, category: str) -> DataFrame:
    """overrides (key, chosen) after `category` is chosen for the keys (key): what other keys of the same rows (array `keys`) said is removed."""
    tied = rows.select("keys").distinct().withColumn("key", F.explode("keys")).join(keys, "key", "left_semi").select(F.explode("keys").alias("key")).distinct()
    return overrides.join(tied, "key", "left_anti").select("key", "chosen").union(keys.select("key").distinct().withColumn("chosen", F.lit(category)))


def code_join(names: DataFrame, items: DataFrame) -> DataFrame:
    """product_name, product_id, score: assembled computers and the items with their code, 1 where the graphics card agrees or is not said, 0.35 where it differs."""
    left = names.select("product_name").distinct().withColumns({"code": D.pc_code(F.col("product_name")), "gpu": D.gpu(F.col("product_name"))}).filter("code IS NOT NULL")
    right = items.select("product_id", "name").withColumns({"code": D.pc_code(F.col("name")), "other_gpu": D.gpu(F.col("name"))}).filter("code IS NOT NULL")
    return left.join(right, "code").select("product_name", "product_id", F.when(F.col("gpu") != F.col("other_gpu"), 0.35).otherwise(1.0).alias("score"))


def product_score(full_name: Column, key: Column, product_name: Column) -> Column:
    """120 where the article of the name is in the product's texts, 110 where it is so without punctuation; 2 a word in its name, 1 a word in its key only."""
    article = D.article(product_name)
    texts = F.upper(F.concat_ws(" ", full_name, key))
    by_article = F.when(texts.contains(article), 120).when(D.compact(texts).contains(D.compact(article)), 110).otherwise(0)
    own = F.filter(D.words(product_name), lambda w: F.length(w) > 2)
    by_words = F.aggregate(own, F.lit(0), lambda acc, w: acc + F.when(F.lower(full_name).contains(w), 2).when(F.lower(key).contains(w), 1).otherwise(0))
    return by_article + by_words
