"""Monitors and power supplies: attributes of names, codes, candidates."""

import pytest
from pyspark.sql import functions as F

from priceloom.operators import families as A


def read(spark, expr, name):
    return spark.createDataFrame([(name,)], "n string").select(expr(F.col("n")).alias("r")).first().r.asDict()


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ('27" LG UltraGear 27GP850-B (27GP850-B) 2560x1440 165Hz White', ("lg", "ultragear27gp850b", "27gp850b", "27", "2560x1440", "165", True)),
        ("Игровой монитор Samsung Odyssey G5 (2560 x 1440, 144 Гц, белый)", ("samsung", "odysseyg5", "", "", "2560x1440", "144", True)),
        ("23.8″ AOC 24B2XH/EU (black)", ("aoc", "24b2xheu", "", "23.8", "", "", False)),
        ("ASUS P24ABC-12 75hz", ("asus", "p24abc1275hz", "p24abc12", "", "", "75", False)),
        ("Generic display", ("", "genericdisplay", "", "", "", "", False)),
    ],
)
def test_monitor_attributes(spark, name, want):
    assert tuple(read(spark, A.monitor, name).values()) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("DeepCool PN750M 750W 80 Plus Gold Full Modular ATX 3.1 White (R-PN750M-FC0W-EU)", ("deepcool", "750", "gold", "full", "rpn750mfc0weu", "", "atx", "3.1", True)),
        ("БП Zalman 600 Вт SFX 80 PLUS, немодульный ZM600-GV", ("zalman", "600", "standard", "non", "zm600gv", "", "sfx", "", False)),
        ("Lian-Li", ("", "", "", "", "", "", "atx", "", False)),
        ("Cougar Polaris Pro 1000W Platinum semi-modular", ("cougar", "1000", "platinum", "semi", "", "polarispro", "atx", "", False)),
    ],
)
def test_psu_attributes(spark, name, want):
    assert tuple(read(spark, A.psu, name).values())[:-1] == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("R-PN750M-FC0W-EU", "R-PN750M-FC0W", True), ("ZM750-GV", "ZM750-GV-BK", True), ("R-PN750M-FC0W-EU", "R-PN850M-FC0W-EU", False), ("", "ZM750", False), ("PS-GB650", "GB650", False), ("XXZM750GV1", "ZM750GV1", True)],
)
def test_same_code(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(A.plain(F.col("a")).alias("a"), A.plain(F.col("b")).alias("b"))
    row = row.select(A.same_code(F.col("a"), F.col("b"), A.without_ends(F.col("a")), A.without_ends(F.col("b")))).first()
    assert row[0] is want


def frames(spark, names, items):
    return spark.createDataFrame([(n,) for n in names], "product_name string"), spark.createDataFrame(items, "product_id string, name string")


def test_monitor_candidates(spark):
    lg = '27" LG UltraGear 27GP850-B (27GP850-B) 2560x1440 165Hz'
    items = [("1", lg), ("2", '24" LG UltraGear 24GP850-B (24GP850-B) 1920x1080 144Hz'), ("3", '27" ASUS UltraGear 27GP850-B 2560x1440 165Hz'), ("4", "LG 27GP850-B (2560x1440, 150 Гц, белый)"), ("5", None), ("6", 'LG 27GP850-B (1920x1080, 60hz) 32"')]
    names, rows = frames(spark, [lg, "Generic display", "", None, "LG 27GP850 (165Hz)"], items)
    got = A.monitor_candidates(names, rows, infer=lambda name: F.lit("Монитор")).collect()
    found = {(r.product_name, r.product_id): (r.score, r.rank) for r in got}
    # 0.91 + 0.04 + 0.03 + 0.005 - 0.05; 0.91 + 0.04 - 0.10 - 0.07; 0.91 + 0.04 + 0.03; 0.91 + 0.04 + 0.005; 0.91 + 0.04 - 0.07.
    assert found == {
        (lg, "1"): (0.999, 1), (lg, "4"): (0.935, 2), (lg, "6"): (0.78, 3),
        ("LG 27GP850 (165Hz)", "1"): (0.98, 1), ("LG 27GP850 (165Hz)", "4"): (0.905, 2), ("LG 27GP850 (165Hz)", "6"): (0.88, 3),
    }
    pool = spark.createDataFrame([("LG 27GP850 (165Hz)", "6", 0.99), ("LG 27GP850 (165Hz)", "2", 0.99)], "product_name string, product_id string, score double")
    best = A.monitor_candidates(names, rows, 1, pool, lambda name: F.lit("Монитор")).filter("product_name LIKE 'LG%'").first()
    assert (best.product_id, best.score) == ("1", 0.98)
    assert A.monitor_candidates(names, rows.limit(0)).collect() == []
    assert A.monitor_candidates(names, rows, infer=lambda name: F.lit("Мышь")).collect() == []


def test_psu_candidates(spark):
    own = "DeepCool PN750M 750W 80 Plus Gold Full Modular ATX 3.1 White (R-PN750M-FC0W-EU)"
    items = [
        ("1", own), ("2", own.replace("PN750M", "PN850M").replace("750W", "850W")), ("3", "DeepCool PN750M 750W 80 Plus Bronze Full Modular ATX 3.1 White"),
        ("4", "Zalman PN750M 750W 80 Plus Gold Full Modular ATX 3.1 White"), ("5", "DeepCool PN750M 750W Gold ATX 3.0"), ("6", "DeepCool Gold power supply black"), ("7", "DeepCool 750W SFX Gold"),
    ]
    names, rows = frames(spark, [own, "Generic power supply", "deepcool 750 Вт gold", None], items)
    got = {(r.product_name, r.product_id): (r.score, r.rank) for r in A.psu_candidates(names, rows, infer=lambda name: F.lit("Блок питания")).collect()}
    # The white ones lose 0.05 against a name that says no colour.
    assert got == {(own, "1"): (0.999, 1), ("deepcool 750 Вт gold", "6"): (0.91, 1), ("deepcool 750 Вт gold", "5"): (0.91, 2), ("deepcool 750 Вт gold", "1"): (0.86, 3)}


def test_kind_is_told_of_distinct_names(spark):
    """The rules of kinds are long: a name that many items have meets them once."""
    told = spark.sparkContext.accumulator(0)

    def kind(name):
        told.add(1)
        return "Блок питания"

    names, rows = frames(spark, ["DeepCool 750W Gold"], [(str(k), f"DeepCool 750W {grade}") for k in range(300) for grade in ("Gold", "Bronze")])
    found = A.psu_candidates(names, rows, 1 << 30, infer=lambda name: F.udf(kind, "string")(name))
    assert found.count() == 300
    assert told.value == 2


def test_ranks_of_items_with_common_names(spark):
    """Items of one name, of several names, of names that differ in letter case only, without an id and in the pool."""
    gold, same, plain = "DeepCool 750W Gold ATX 3.0", "DEEPCOOL 750w Gold ATX 3.0", "DeepCool 750W"
    items = [(f"{k:02}", gold) for k in range(0, 20, 2)] + [(f"{k:02}", same) for k in range(1, 20, 2)] + [("30", plain), ("30", gold), ("31", plain), (None, plain), (None, same)]
    names, rows = frames(spark, ["deepcool 750 Вт (atx 3.0)"], items)
    pool = spark.createDataFrame([("deepcool 750 Вт (atx 3.0)", "31", 0.98), ("deepcool 750 Вт (atx 3.0)", "05", 0.95)], "product_name string, product_id string, score double")
    ids = [None, *(f"{k:02}" for k in range(20)), "30"]
    for given, want in ((None, [*ids, "31"]), (pool, ["31", "05", *(k for k in ids if k != "05")])):
        for most in (1 << 30, 4):
            found = sorted(A.psu_candidates(names, rows, most, given, lambda name: F.lit("Блок питания")).collect(), key=lambda r: r["rank"])
            assert [r.product_id for r in found] == want[:most]
            assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
    named = {r.product_id: (r.name, r.score) for r in found}
    assert named == {"31": (plain, 0.98), "05": (same, 0.965), None: (same, 0.925), "00": (gold, 0.925)}
