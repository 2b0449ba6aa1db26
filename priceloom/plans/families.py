"""Queries on product families whose names are put together in several ways; their SQL knows the attributes only."""

from pyspark.sql import functions as F

from priceloom.operators import families as A
from priceloom.plans.registry import query
from priceloom.sources.tables import stored, table


def _of(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _div(k, n):
    return F.floor(k / n)


def _numbered(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("product_id"))


def _asked(pairs, names):
    """The pairs with the smallest number of those that are called so, in place of the name."""
    # Written, so that Spark knows how few they are.
    return stored(names.groupBy("product_name").agg(F.min("k").alias("asked"))).join(pairs, "product_name").select("asked", "product_id", "score")


_MONITOR = """, m AS (SELECT p_partkey AS k, k % 5 AS maker, [24, 27, 32][(k // 5) % 3 + 1] AS size, (k // 15) % 40 + 10 AS n, (k // 7) % 2 AS series, CASE WHEN (k // 2) % 2 = 0 THEN (k // 4) % 2 END AS code, (k // 11) % 2 AS res, [60, 75, 144, 165][(k // 3) % 4 + 1] AS hz, k % 7 = 0 AS white FROM part),
asked AS (SELECT min(k) AS asked, maker, size, n, series, CASE WHEN k % 4 < 2 THEN code END AS code, res, CASE WHEN k % 3 = 0 THEN hz + 15 ELSE hz END AS hz, white, CASE k % 3 WHEN 1 THEN size WHEN 2 THEN 24 END AS said FROM m WHERE k % 6 IN (1, 2, 3) GROUP BY ALL)"""


@query(f"""{_MONITOR}, p AS (SELECT asked, b.k::VARCHAR AS product_id, coalesce(a.code = b.code, false) AS coded, a.series = b.series AS exact, a.res = b.res AS same_res, a.hz - b.hz AS apart, a.white <> b.white AS colour,
  CASE WHEN b.k % 2 = 0 AND said IS NOT NULL THEN CASE WHEN said = b.size THEN 0.03 ELSE -0.10 END ELSE 0 END AS sized FROM asked a JOIN m b USING (maker, size, n))
SELECT asked, product_id, round(least(0.999, (CASE WHEN coded THEN 1.02 ELSE 0.91 END + CASE WHEN exact THEN 0.07 ELSE 0.04 END + sized + CASE WHEN same_res THEN 0.03 ELSE -0.10 END
  + CASE WHEN apart = 0 THEN 0.03 WHEN abs(apart) <= 20 THEN 0.005 ELSE -0.07 END - CASE WHEN colour THEN 0.05 ELSE 0 END))::DOUBLE, 3) AS score FROM p""")
def monitor_matches(spark, sf_dir):
    """All candidates of monitors that suppliers call by model, with or without code and size, some with another refresh rate or size."""
    rows, k = _numbered(spark, sf_dir), F.col("k")
    maker, size, res = _of(("LG", "Samsung", "ASUS", "AOC", "Dell"), k % 5), _of((24, 27, 32), _div(k, 5) % 3), _of(("1920x1080", "2560x1440"), _div(k, 11) % 2)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    model = text(F.when(_div(k, 7) % 2 == 1, "UltraGear ").otherwise(""), size, "GP", _div(k, 15) % 40 + 10)
    code = F.when(_div(k, 2) % 2 == 0, text(size, "GP", _div(k, 15) % 40 + 10, "-", _of(("B1", "W1"), _div(k, 4) % 2)))
    hz = _of((60, 75, 144, 165), _div(k, 3) % 4)
    white = lambda word: F.when(k % 7 == 0, word).otherwise("")
    listed = text(F.when(k % 2 == 0, text(size, '" ')).otherwise("Монитор "), maker, " ", model, " (", F.coalesce(code, F.lit("IPS panel")), ") ", res, " ", hz, "Hz", white(" White"))
    said = F.when(k % 3 == 1, text(size, '" ')).when(k % 3 == 2, '24" ').otherwise("Игровой монитор ")
    mine = F.when(k % 4 < 2, F.coalesce(text(" (", code, ")"), F.lit(""))).otherwise("")
    called = text(said, F.upper(maker), "  ", F.lower(model), mine, " (", F.replace(res, F.lit("x"), F.lit(" x ")), ", ", F.when(k % 3 == 0, hz + 15).otherwise(hz), " Гц", white(", белый"), ")")
    names = stored(rows.filter((k % 6).isin(1, 2, 3)).select("k", called.alias("product_name")))
    return _asked(A.monitor_candidates(names, rows.select("product_id", listed.alias("name")), 1 << 30, infer=lambda name: F.lit("Монитор")), names)


_PSU = """, u AS (SELECT p_partkey AS k, k % 4 AS maker, [550, 650, 750][(k // 4) % 3 + 1] AS watt, nullif((k // 12) % 3, 2) AS grade, nullif((k // 5) % 3, 2) AS cables, k % 10 = 3 AS sfx,
  CASE WHEN (k // 7) % 2 = 0 THEN (k // 36) % 8 * 1000 + watt END AS code, [3.0, 3.1, 2.4, NULL][(k // 6) % 4 + 1] AS atx, nullif((k // 8) % 3, 2) AS series, k % 5 = 0 AS white FROM part),
asked AS (SELECT min(k) AS asked, maker, watt, grade, cables, sfx, code, atx, series, white FROM u WHERE k % 6 = 1 GROUP BY ALL)"""


@query(f"""{_PSU}, p AS (SELECT asked, b.k::VARCHAR AS product_id, coalesce(a.code = b.code, false) AS coded, a.series AS s, b.series AS t, a.atx - b.atx AS apart, a.white <> b.white AS colour FROM asked a JOIN u b ON a.maker = b.maker AND a.sfx = b.sfx
  AND (b.k % 13 = 0 OR a.watt = b.watt) AND coalesce(a.grade = b.grade, true) AND coalesce(a.cables = b.cables, true) AND coalesce(a.code = b.code, true)),
q AS (SELECT *, bool_or(coded) OVER (PARTITION BY asked) AS hit FROM p)
SELECT asked, product_id, round(least(0.999, CASE WHEN coded THEN 0.999 ELSE 0.91 END + CASE WHEN s = t THEN 0.05 WHEN s <> t THEN -0.08 ELSE 0 END + CASE WHEN abs(apart) <= 0.11 THEN 0.015 WHEN apart IS NOT NULL THEN -0.05 ELSE 0 END
  - CASE WHEN colour THEN 0.05 ELSE 0 END)::DOUBLE, 3) AS score FROM q WHERE coded OR NOT hit""")
def psu_matches(spark, sf_dir):
    """All candidates of power supplies, called in another order than the catalog lists them; codes there may end in a colour."""
    rows, k = _numbered(spark, sf_dir), F.col("k")
    text = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    maker, watt = ("DeepCool", "Zalman", "Chieftec", "Cougar"), _of((550, 650, 750), _div(k, 4) % 3)
    grade, cables = (lambda forms: _of((*forms, None), _div(k, 12) % 3)), (lambda forms: _of((*forms, None), _div(k, 5) % 3))
    code = F.when(_div(k, 7) % 2 == 0, F.concat(F.lit("PN10"), (_div(k, 36) % 8).cast("string"), F.lit("-"), watt.cast("string")))
    atx = _of(("3.0", "3.1", "2.4", None), _div(k, 6) % 4)
    series, sfx = _of(("Polaris", "Pylon", None), _div(k, 8) % 3), F.when(k % 10 == 3, "SFX")
    ended = F.when(k % 9 == 0, F.concat(code, F.lit("-BK"))).otherwise(code)
    power = F.when(k % 13 != 0, F.concat(watt.cast("string"), F.lit("W")))
    listed = text("Блок питания", _of(maker, k % 4), series, ended, power, grade(("80 Plus Gold", "80 Plus Bronze")), cables(("Full Modular", "Non-Modular")), F.concat(F.lit("ATX "), atx), sfx, F.when(k % 5 == 0, "White"))
    called = text(sfx, F.concat(watt.cast("string"), F.lit(" Вт")), F.lower(_of(maker, k % 4)), cables(("полностью модульный", "немодульный")), F.concat(F.lit("(atx"), atx, F.lit(")")), grade(("GOLD", "BRONZE")), F.when(k % 5 == 0, "белый"), F.lower(series), F.lower(code))
    names = stored(rows.filter(k % 6 == 1).select("k", called.alias("product_name")))
    return _asked(A.psu_candidates(names, rows.select("product_id", listed.alias("name")), 1 << 30), names)
