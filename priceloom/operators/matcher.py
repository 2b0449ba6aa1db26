"""Whether two product names mean one product: a cascade of column rules, the first that fires decides.

Names are described once each (identity codes, models, sizes, colours, packs, kind and brand) in a written table, pairs are
joined with both descriptions, and the rules compare arrays. Only pairs that no rule decides reach the likeness of texts, which Spark lacks; it
runs as a pandas UDF over their distinct texts. Where only scores from `least` on are asked for, a bound from how often the
characters occur in both texts is worked out first, without Python, and pairs that can't reach it go no further.
"""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from priceloom.functions import models as D
from priceloom.functions import text as X
from priceloom.operators.similarity import spread
from priceloom.sources.tables import discard, stored

DESCRIBED = {
    "strict": D.strict_articles, "variants": D.variants, "numeric": D.numeric_codes, "modifiers": D.modifiers, "connections": D.connections, "kind": D.kind, "pc": D.pc_code, "gpu": D.gpu,
    "board": D.board, "pack": D.fan_pack, "series": D.fan_series, "article": D.article, "numbers": D.numeric_models, "apple": D.apple_articles, "likes": D.article_likes, "paren": D.paren_models,
    "hints": D.model_hints, "sizes": X.capacity_tokens, "colours": D.colours, "important": D.important_tokens, "brand": D.brand, "text": D.match_text,
}
#: Characters of ordered words and of a name's text that are compared, and groups of characters that are counted for the bound.
ORDERED, TEXT, GROUPS = 300, 260, 64
#: The score of names whose strict articles differ; only blank names are judged before it.
STRICT_APART = 0.16
#: Reasons that rest on an identity of the product.
STRONG = ("article", "article_like", "apple_article", "strict_article", "paren_model", "motherboard_model", "tgpc_code_exact")


def letters(text: Column) -> Column:
    """How many characters of each of GROUPS groups a text has."""
    groups = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.pmod(F.xxhash64(c), F.lit(GROUPS)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda k: F.size(F.filter(groups, lambda g: g == k)))


def described(names: DataFrame) -> DataFrame:
    """The distinct names (one column) with what each says, as a written table: both sides of all pairs read it."""
    own = spread(names.toDF("own").distinct())
    rows = own.select("own", *[of(F.col("own")).alias(what) for what, of in DESCRIBED.items()], D.name_tokens(D.match_text(F.col("own"))).alias("tokens"))
    rows = stored(rows.withColumns({"ordered": F.substring(F.array_join(F.array_sort("tokens"), " "), 1, ORDERED), "begin": F.substring("text", 1, TEXT)}))
    discard(own)
    out = stored(rows.withColumns({"ordered_letters": letters(F.col("ordered")), "begin_letters": letters(F.col("begin"))}))
    discard(rows)
    return out


def _some(x: Column) -> Column:
    return F.size(x) > 0


def _apart(a: Column, b: Column) -> Column:
    """Both have some, none in common."""
    return _some(a) & _some(b) & ~F.arrays_overlap(a, b)


def _met(a: Column, b: Column) -> Column:
    return _some(a) & _some(b) & F.arrays_overlap(a, b)


def _says(score: Column | float, match: Column | bool, reason: str) -> Column:
    value = F.lit(score) if isinstance(score, float) else score
    return F.struct(F.round(value, 3).alias("score"), (F.lit(match) if isinstance(match, bool) else match).alias("match"), F.lit(reason).alias("reason"))


def _capped(score: Column, *caps: tuple[Column, float]) -> Column:
    """The score, at most each cap whose test holds; written so that the score stands in the plan once."""
    return F.least(score, *[F.when(test, F.lit(cap)) for test, cap in caps])


def _raised(score: Column, *floors: tuple[Column, float]) -> Column:
    return F.greatest(score, *[F.when(test, floor) for test, floor in floors])


def _plus(test: Column, more: float) -> Column:
    return F.when(test, F.lit(more)).otherwise(0.0)


def decided(a, b) -> Column:
    """score, match, reason by the rules that need no likeness of texts; null where none fires. a, b: columns by what they hold."""
    blank = (F.coalesce(X.strip(a("name")), F.lit("")) == "") | (F.coalesce(X.strip(b("name")), F.lit("")) == "")
    apart = lambda what: _apart(a(what), b(what))
    met = lambda what: _met(a(what), b(what))
    alone = _some(a("colours")) & ~_some(b("colours"))
    unpacked = (a("pack") > 0) & (b("pack") == 0)
    packed = (a("pack") > 0) & (b("pack") > 0)

    both_pc = a("pc").isNotNull() & b("pc").isNotNull()
    computers = F.when(both_pc, F.when(a("pc") != b("pc"), _says(0.04, False, "tgpc_code_mismatch")).when(a("gpu") != b("gpu"), _says(0.35, False, "tgpc_gpu_mismatch")).otherwise(_says(1.0, True, "tgpc_code_exact")))

    one, other = a("board"), b("board")
    makers = (one["brand"] != "") & (other["brand"] != "") & (one["brand"] != other["brand"])
    begins = (F.least(F.length(one["model"]), F.length(other["model"])) >= 8) & (one["model"].startswith(other["model"]) | other["model"].startswith(one["model"]))
    close = F.when(_some(F.array_except(one["features"], other["features"])), _says(0.35, False, "motherboard_model_mismatch")).otherwise(_says(0.92, True, "motherboard_model_close"))
    same_chipset = (one["chipset"] != "") & (one["chipset"] == other["chipset"])
    boards = F.when(
        one.isNotNull() & other.isNotNull(),
        F.when(makers, _says(0.04, False, "motherboard_brand_mismatch")).when(one["model"] == other["model"], _says(0.996, True, "motherboard_model")).when(begins, close)
        .when(same_chipset, _says(0.35, False, "motherboard_model_mismatch")).otherwise(_says(0.18, False, "motherboard_model_mismatch")),
    )

    exact_variant = F.exists(F.array_intersect(a("series"), b("series")), lambda t: ~t.rlike("(?:120|140|240|360)$"))
    series = F.when(exact_variant, 0.995).otherwise(0.965)
    series = _capped(series + _plus(packed, 0.006), (packed, 0.999), (unpacked, 0.78))
    fans = F.when(met("series"), _says(series, True, "fan_series"))

    score = _capped(F.lit(1.0), (apart("sizes"), 0.84), (apart("colours"), 0.88), (alone, 0.97), (apart("connections"), 0.78))
    articles = F.when(a("article") == b("article"), F.when(unpacked, _says(0.72, True, "article_pack_mismatch")).otherwise(_says(score, score >= 0.74, "article")))

    numbers = F.when(met("numbers"), _says(0.995, True, "numeric_model"))
    apples = F.when(met("apple"), _says(1.0, True, "apple_article")).when(apart("apple"), _says(0.18, False, "apple_article_conflict"))

    shared = F.array_intersect(a("likes"), b("likes"))
    long = lambda x, n: F.filter(x, lambda t: F.length(t) >= n)
    score = F.when(_some(long(shared, 6)), 0.995).otherwise(0.97)
    score = F.when(_apart(long(a("likes"), 6), long(b("likes"), 6)), 0.90).otherwise(score)
    identity = F.array_union(a("strict"), b("strict"))
    score = _capped(score, (_apart(long(a("likes"), 10), long(b("likes"), 10)), 0.88), (_some(identity) & ~F.arrays_overlap(shared, identity), 0.72), (apart("sizes"), 0.83))
    in_common = F.array_intersect(a("colours"), b("colours"))
    coloured = F.when(F.size(in_common) >= F.size(a("colours")), 0.995).otherwise(0.97)
    tinted = met("colours") & ~apart("sizes")
    score = _capped(_raised(score, (tinted, coloured)), (_some(a("colours")) & _some(b("colours")) & ~tinted, 0.88))
    score = _capped(score - _plus(alone & (score > 0.90), 0.02), (apart("connections"), 0.78))
    likes = F.when(met("likes"), _says(score, score >= 0.74, "article_like"))

    parens = F.when(_some(D.family_hits(a("paren"), b("paren"))), F.when(unpacked, _says(0.72, True, "paren_pack_mismatch")).otherwise(_says(0.94, True, "paren_model")))

    hits = D.family_hits(a("hints"), b("hints"))
    score = F.when(F.arrays_overlap(hits, a("paren")), 0.90).otherwise(0.84)
    score = _raised(score, (_some(F.array_intersect(F.array_intersect(hits, a("variants")), b("variants"))), F.lit(0.98)), (met("sizes"), F.lit(0.92)))
    score = _capped(score + _plus(met("colours"), 0.015), (met("colours"), 0.999), (apart("colours"), 0.88), (alone, 0.95))
    score = _capped(_raised(score, (packed, F.when(a("pack") == b("pack"), 0.985).otherwise(0.94))), (unpacked, 0.72))
    hints = F.when(_some(hits), _says(score, True, "model_token"))

    vento = [D.has(side("name"), r"\bvento\s+r\b") for side in (a, b)]
    score = F.when(met("colours"), 0.985).when(apart("colours"), 0.94).otherwise(0.96)
    score = _capped(score + _plus(vento[0] & vento[1], 0.006), (vento[0] & vento[1], 0.995), (vento[0] & ~vento[1], 0.965))
    packs = F.when(packed & (a("brand") == b("brand")) & (F.size(F.array_intersect(a("tokens"), b("tokens"))) >= 3), _says(score, True, "fan_pack_tokens"))

    strangers = F.when(_some(a("likes")) & _some(b("likes")) & ~_some(D.family_hits(a("likes"), b("likes"))), _says(0.18, False, "article_conflict"))
    cables = a("kind").isin(*D.CABLE_KINDS) & b("kind").isin(*D.CABLE_KINDS)
    kinds = F.when((a("kind") != b("kind")) & ~cables, _says(0.02, False, "category_mismatch"))
    return F.coalesce(
        F.when(blank, _says(0.0, False, "no_name")),
        F.when(met("strict"), _says(1.0, True, "strict_article")).when(apart("strict"), _says(STRICT_APART, False, "strict_article_conflict")),
        F.when(D.variants_conflict(a("variants"), b("variants")), _says(0.14, False, "model_variant_conflict")),
        F.when(apart("numeric"), _says(0.12, False, "numeric_article_conflict")),
        computers, boards, fans, articles, numbers, apples, likes, parens, hints, packs, strangers, kinds,
    )


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of both texts SequenceMatcher finds in common; the order of the arguments matters. Equal pairs of a batch are compared once."""
    known = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            x, y = pair[0] or "", pair[1] or ""
            known[pair] = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)])


def most_alike(a: Column, b: Column, x: Column, y: Column) -> Column:
    """No less than the likeness of two texts a and b with the letters x and y: what they have in common can't be more than the characters that both have."""
    common = F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0), lambda s, n: s + n)
    size = F.length(a) + F.length(b)
    return F.when(F.coalesce(size, F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * common / size))


def reachable(rows: DataFrame, a, b, least: float) -> DataFrame:
    """The pairs that no rule decides whose score may be `least` or more: a larger likeness never lowers a score."""
    bounds = {"by_tokens": most_alike(a("ordered"), b("ordered"), a("ordered_letters"), b("ordered_letters")), "by_text": most_alike(a("begin"), b("begin"), a("begin_letters"), b("begin_letters"))}
    by_tokens = F.when(_some(a("tokens")) & _some(b("tokens")), F.col("by_tokens")).otherwise(0.0)
    most = blended(rows.withColumns(bounds), a, b, by_tokens, F.col("by_text"))
    return most.filter(F.col("verdict.score") >= least).select(*rows.columns)


def blended(rows: DataFrame, a, b, by_tokens: Column, by_text: Column) -> DataFrame:
    """rows with the verdict (score, match, reason) from shared words and the two likenesses, for pairs that no rule decides."""
    met = lambda what: _met(a(what), b(what))
    apart = lambda what: _apart(a(what), b(what))
    overlap = F.when(_some(a("tokens")) & _some(b("tokens")), F.size(F.array_intersect(a("tokens"), b("tokens"))) / F.least(F.size(a("tokens")), F.size(b("tokens")))).otherwise(0.0)
    hits = F.size(F.array_intersect(a("important"), b("important")))
    same_brand = F.coalesce(a("brand") == b("brand"), F.lit(False))
    left, right = D.compact(a("text")), D.compact(b("text"))
    holds = (left != "") & (right != "") & (left.contains(right) | right.contains(left))
    rows = rows.withColumns({"_overlap": overlap, "_hits": hits, "_brand": same_brand, "_holds": holds, "_mount_a": D.mount_model(a("name"), a("brand")), "_mount_b": D.mount_model(b("name"), b("brand"))})
    overlap, hits, same_brand = F.col("_overlap"), F.col("_hits"), F.col("_brand")
    score = 0.58 * overlap + 0.24 * by_tokens + 0.18 * by_text + _plus(F.col("_holds"), 0.08) + _plus(same_brand, 0.05)
    score = score + _plus(hits >= 2, 0.12) + _plus((hits >= 2) & same_brand, 0.08) + _plus(hits >= 3, 0.05) + _plus(met("sizes"), 0.10) - _plus(apart("sizes"), 0.14)
    score = _capped(score + _plus(met("colours"), 0.03), (apart("colours"), 0.88), (_some(a("colours")) & ~_some(b("colours")), 0.95))
    score = _capped(score - _plus(_some(a("hints")) & _some(b("hints")), 0.22) - _plus(_apart(a("paren"), b("hints")), 0.10), (apart("numbers"), 0.74))
    packs = F.when((a("pack") > 0) & (b("pack") > 0), F.when(a("pack") == b("pack"), 0.10).otherwise(0.04)).when(a("pack") > 0, -0.18).otherwise(0.0)
    score = _capped(score + packs, (_some(F.array_except(a("modifiers"), b("modifiers"))), 0.90), (_some(F.array_except(b("modifiers"), a("modifiers"))), 0.94))
    score = score + F.least(F.lit(0.18), 0.09 * F.size(F.array_intersect(a("modifiers"), b("modifiers"))))
    one, other = F.col("_mount_a"), F.col("_mount_b")
    mounts = same_brand & (one != "") & (other != "")
    nested = one.startswith(other) | other.startswith(one)
    score = _capped(_raised(score, (mounts & (one == other), F.lit(0.995))), (mounts & (one != other) & nested, 0.92), (mounts & ~nested, 0.78))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)
    rows = rows.withColumn("_score", _capped(score, (a("pc").isNotNull() & b("pc").isNull(), 0.72)))
    score = F.col("_score")
    good = (score >= 0.64) | (overlap >= 0.78) | (by_text >= 0.84) | (same_brand & (hits >= 2) & (score >= 0.72))
    reason = F.when(same_brand & (hits >= 2), "brand_model_tokens").otherwise("tokens")
    return rows.withColumn("verdict", F.struct(score.alias("score"), good.alias("match"), reason.alias("reason")))


def match_names(pairs: DataFrame, least: float | None = None) -> DataFrame:
    """pairs (product_name, name and any other columns) with score, match and reason; with `least` only those of that score or more.

    Blank and null names score 0. Both sides are described once for each distinct name; pairs are judged once for each
    distinct pair.
    """
    a = lambda what: F.col("product_name" if what == "name" else f"a_{what}")
    b = lambda what: F.col("name" if what == "name" else f"b_{what}")
    distinct = spread(pairs.select("product_name", "name").distinct())
    names = described(distinct.select("product_name").union(distinct.select("name")))
    both = distinct
    for side, key in (("a", "product_name"), ("b", "name")):
        own = names.select(*[F.col(c).alias(f"{side}_{c}") for c in names.columns])
        both = both.join(own, F.col(key).eqNullSafe(F.col(f"{side}_own"))).drop(f"{side}_own")
    both = stored(both.withColumn("verdict", decided(a, b)))
    open_ = both.filter("verdict IS NULL")
    if least is not None:
        open_ = stored(reachable(open_, a, b, least))
    by_tokens = F.when(_some(a("tokens")) & _some(b("tokens")), F.col("by_tokens")).otherwise(0.0)
    likely = open_.withColumns({"by_tokens": likeness(a("ordered"), b("ordered")), "by_text": likeness(a("begin"), b("begin"))})
    blend = blended(likely, a, b, by_tokens, F.col("by_text")).select("product_name", "name", "verdict")
    judged = both.filter("verdict IS NOT NULL").select("product_name", "name", "verdict").unionByName(blend)
    if least is not None:
        judged = judged.filter(F.col("verdict.score") >= least)
    judged = stored(judged.select(F.col("product_name").alias("_a"), F.col("name").alias("_b"), "verdict"))
    discard(distinct, names, both, *[open_] * (least is not None))
    same = F.col("product_name").eqNullSafe(F.col("_a")) & F.col("name").eqNullSafe(F.col("_b"))
    return pairs.join(judged, same).select(*pairs.columns, "verdict.score", "verdict.match", "verdict.reason")


def admissible(pairs: DataFrame) -> DataFrame:
    """match_names with allowed and why: a candidate of another kind or brand is out, unless an identity ties the names."""
    judged = match_names(pairs)
    kinds = [D.kind(F.col(c)) for c in ("product_name", "name")]
    brands = [D.brand(F.col(c)) for c in ("product_name", "name")]
    compacts = [D.compact(F.col(c)) for c in ("product_name", "name")]
    empty = (F.coalesce(X.strip(F.col("product_name")), F.lit("")) == "") | (F.coalesce(X.strip(F.col("name")), F.lit("")) == "")
    foreign = ~compacts[0].contains(brands[1]) & ~compacts[1].contains(brands[0])
    why = (
        F.when(empty, "empty").when(kinds[0] != kinds[1], "category")
        .when(F.col("match") & F.col("reason").isin(*STRONG) & (F.col("score") >= 0.74), "strong_identity")
        .when(brands[0].isNotNull() & brands[1].isNull(), "brand_missing").when((brands[0] != brands[1]) & foreign, "brand").otherwise("ok")
    )
    return judged.withColumns({"allowed": why.isin("strong_identity", "ok"), "why": why})
