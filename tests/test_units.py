import json

import pytest
from pyspark.sql import functions as F

from priceloom.functions import category_rules as R
from priceloom.functions import models as D
from priceloom.functions import payloads as Y
from priceloom.functions import pricing
from priceloom.functions import text as X
from priceloom.operators import categories, review
from priceloom.operators import catalog, consolidate, journal, market, matcher, matching
from priceloom.plans import more, registry  # noqa: F401
from priceloom.sources import suppliers, tables
from priceloom.streaming import events


def values(spark, column, *given):
    rows = spark.createDataFrame([(k, g) for k, g in enumerate(given)], f"k int, v {'double' if isinstance(given[0], float) else 'string'}")
    return [r.x for r in rows.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_ids_and_names(spark):
    assert values(spark, X.normalize_id, "123.0", " 7 ", "nan", "None", "", None) == ["123", "7", None, None, None, None]
    assert values(spark, X.name_key, " [new]  Дрель  X ", "A  b") == ["дрель x", "a b"]
    assert values(spark, X.capacity_tokens, "SSD 1TB / HDD 500GB / eMMC 1.0GB") == [["1gb", "1tb", "500gb"]]
    assert values(spark, D.name_tokens, "Клавиатура Logitech K380 White") == [["клавиатура", "logitech", "k380"]]
    assert values(spark, X.delivery_days, "5 days", "soon", None) == ["5", "2", "2"]


def test_money(spark):
    assert values(spark, X.money, "1 234,50", "12 000", "x", "nan", None) == [1234.5, 12000.0, None, None, None]
    assert values(spark, pricing.round_to_tens, 14.9, 15.0, 0.0, -3.0, 104.99) == [10.0, 20.0, 0.0, 0.0, 100.0]


def offers(spark, rows):
    return spark.createDataFrame(rows, "supplier string, supplier_code string, product_id string, product_name string, price double, warranty int, delivery string, rrp double, category string, pos int")


def test_cheapest_row_longest_warranty_first_delivery(spark):
    rows = [("S", "A-1", "123", "expensive", 120.0, 36, "5 days", 150.0, "c", 1), ("S", "A-1", "123", "cheapest", 100.0, 12, "2 days", 130.0, "c", 2), ("S", None, None, "SSD", 300.0, None, None, None, "c", 3), ("S", "", None, "ssd ", 250.0, None, None, None, "c", 4), ("T", "9", "123", "other", None, None, None, None, None, 5)]
    got = {(r.supplier, r.row_key): r for r in consolidate.consolidate(offers(spark, rows)).collect()}
    one = got["S", "code:A-1"]
    assert (one.product_name, one.price, one.warranty, one.delivery_days, one.rrp) == ("cheapest", 100.0, 36, "5", 130.0)
    assert got["S", "name:ssd"].price == 250.0
    lowest = consolidate.keep_lowest(offers(spark, rows)).collect()
    assert sorted((r.product_id or "", r.pos) for r in lowest) == [("", 3), ("", 4), ("123", 2)]
    assert consolidate.keep_lowest(offers(spark, [])).count() == 0


def test_price_file_with_preamble(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("Прайс,,,\n,,,\nКод,Наименование,Цена,Гарантия\n155250.0,SSD 1TB,\"100,50\",24\nX2,Mouse,0,12\n155250,again,5,1\n,Cable,7,\n")
    got = sorted((r.supplier_code or "", r.product_name, r.price, r.warranty) for r in tables.read_price_file(spark, str(path), "S").collect())
    assert got == [("", "Cable", 7.0, None), ("155250", "SSD 1TB", 100.5, 24)]


def test_snapshot_and_payload(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"data": [["10", "SSD", 120, "I", "12", "2", 140, 150, 5, "c"], ["", "Cable", "x"]]}))
    rows = tables.read_snapshot(spark, str(tmp_path / "s.json"))
    assert [(r.product_name, r.price, r.category) for r in rows.orderBy("product_id").collect()] == [("Cable", None, None), ("SSD", 120.0, "c")]
    tables.write_snapshot(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    payload = json.dumps({"positions": {"a": [{"shop_id": "1", "position_price": {"amount": "5", "converted": {"BYN": {"amount": "4,5"}}}}, {"shop_id": "2", "position_price": {"amount": "6"}}]}, "shops": {"1": {"title": "One"}}})
    got = tables.market_positions(spark.createDataFrame([("10", payload), ("11", None)], "product_id string, payload string")).collect()
    assert sorted((r.seller or "", r.price) for r in got) == [("", 6.0), ("One", 4.5)]


def test_rollback_undoes_only_what_still_holds(spark):
    rows = offers(spark, [("S", "1", "7", "bolt", 1.0, 1, None, 1.0, "c", 1), ("S", "2", "8", "nut", 1.0, 1, None, 1.0, "c", 2)])
    cleared, changes = journal.clear_ids(rows, F.col("product_name") == "bolt")
    assert [r.product_id for r in cleared.orderBy("pos").collect()] == [None, "8"]
    assert [r.product_id for r in journal.rollback(cleared, changes).orderBy("pos").collect()] == ["7", "8"]


VERDICTS = [
    ("", "x", 0.0, False, "no_name"), (None, "x", 0.0, False, "no_name"),
    ("Моноблок MSI 9S6-AF8221-1234", "MSI Pro 9S6-AF8221-1234", 1.0, True, "strict_article"), ("MSI 9S6-AF8221-1234", "MSI 9S6-AF8221-9999", 0.16, False, "strict_article_conflict"),
    ("Кулер DeepCool AK400", "DeepCool AK620", 0.14, False, "model_variant_conflict"), ("Ручка 111-222333", "Ручка 111-222444", 0.12, False, "numeric_article_conflict"),
    ("ПК 12345 A-X RTX 4060", "Компьютер 12346 B-X RTX 4060", 0.04, False, "tgpc_code_mismatch"), ("ПК 12345 A-X RTX 4060", "Компьютер 12345 B-X RTX 4070", 0.35, False, "tgpc_gpu_mismatch"), ("ПК 12345 A-X", "Компьютер 12345 B-X RTX 4070", 1.0, True, "tgpc_code_exact"),
    ("MB ASUS PRIME B650M-A Socket AM5", "Материнская плата ASUS Prime B650M-A", 0.996, True, "motherboard_model"), ("MB MSI B650M-A", "Материнская плата ASUS B650M-A", 0.04, False, "motherboard_brand_mismatch"),
    ("Вентилятор Crystal 120 White", "Fan Crystal 120 white", 0.995, True, "fan_series"), ("Вентилятор Crystal 120 x3", "Fan Crystal 120", 0.78, True, "fan_series"),
    ("SSD Kingston 1TB (SNV3S/1000G)", "Накопитель Kingston SNV3S/1000G", 1.0, True, "article"), ("Apple MacBook Air MQKP3", "Apple MacBook MQKW3", 0.18, False, "apple_article_conflict"),
    ("Клавиатура Logitech K380 White", "Клавиатура Logitech K380 Black", 0.88, True, "model_token"), ("Palit RTX 4070", "Palit RTX 4060", 0.18, False, "article_conflict"),
    ("Мышь Genius", "Клавиатура Genius", 0.02, False, "category_mismatch"), ("Red Bolt", "red bolt", 1.0, True, "tokens"),
]


def test_verdicts_on_names(spark):
    pairs = spark.createDataFrame([(a, b, "kept") for a, b, *_ in VERDICTS], "product_name string, name string, extra string")
    got = {(r.product_name, r.name): (r.score, r.match, r.reason) for r in matcher.match_names(pairs).collect() if r.extra == "kept"}
    assert got == {(a, b): tuple(v) for a, b, *v in VERDICTS}


def test_what_names_say(spark):
    assert values(spark, D.brand, "Игровая мышь Logitech G102", "Кулер для процессора DeepCool AK400", "123") == ["logitech", "deepcool", None]
    assert values(spark, D.kind, "Кулер для процессора X", "Psu 700W", "Нечто") == ["кулер", "бп", None]
    assert values(spark, X.capacity_tokens, "Kit 2x16GB DDR5", "1,5TB", "none") == [["32gb"], ["1.5tb"], []]
    assert values(spark, D.name_tokens, "БП 750W Gold для ПК") == [["750w", "750"]]
    assert values(spark, D.fan_pack, "Набор вентиляторов 3 в 1 fan", "Fan 120x3", "SSD x3") == [0, 3, 0]
    assert values(spark, D.match_text, "Мышь (Black/White) M1 (M-100)") == ["мышь m1 m 100"]


def test_categories_of_names(spark):
    named = {
        "Бумага A4": "Бумага и материалы для печати", "[Новинка] Блендер X": "Блендеры", "Сетевой адаптер TP-Link Wi-Fi": "Беспроводные адаптеры", "Сетевая карта Intel": "Сетевые адаптеры",
        "Держатель для бит Bosch": "Хозяйственные инструменты", "Держатель для ТВ": "Кронштейны", "Переходник для дрели": "Строительный, слесарный, монтажный инструмент", "Переходник HDMI": "Кабели и переходники",
        "Корпус без БП": "Корпус", "БП Chieftec 700W": "Блок питания", "27\" LG IPS HDMI": "Монитор", "SSD Kingston": "SSD", "4TB WD Gold": "Жесткий диск", "Разветвитель USB HUB-4": "USB-хабы", "Разветвитель USB": "Кабели и переходники",
        "GeForce RTX 4060": "Видеокарта", "Шуруповёрт Makita": "Шуруповерты, гайковерты, электроотвертки", "Нечто иное": "НЕЧТО", "": "Без категории", "Intel Core i5": "Процессор", "Стойка для микрофона": "Акустика",
    }
    assert dict(zip(named, values(spark, R.category, *named), strict=True)) == named
    assert values(spark, R.canonical, "USB 3,0", " Принтер и МФУ", "SSD", " ") == ["Накопители USB", "Принтеры", "SSD", None]


def test_admissible(spark):
    pairs = [("Мышь Genius", "Клавиатура Genius"), ("Мышь Genius X", "Мышь Logitech X"), ("Мышь Genius DX-110", "Genius DX-110 мышь"), ("", "a"), ("Red Bolt", "red bolt")]
    got = {(r.product_name, r.name): (r.allowed, r.why) for r in matcher.admissible(spark.createDataFrame(pairs, "product_name string, name string")).collect()}
    assert [got[p] for p in pairs] == [(False, "category"), (False, "brand"), (True, "strong_identity"), (False, "empty"), (True, "ok")]


def test_tiers(spark):
    rows = [("a", "1", 1.0, True, "exact_name", False), ("b", "1", 0.9, False, "x", False), ("b", "2", 0.89, False, "x", False), ("c", "1", 0.98, False, "apple_article", False), ("d", "1", 0.98, False, "tokens", False), ("e", "1", 0.9, False, "x", True), ("f", "1", 1.0, True, "exact_name", True), ("f", "2", 0.3, False, "x", False)]
    found = matching.tiers(spark.createDataFrame(rows, "product_name string, product_id string, score double, exact boolean, reason string, rejected boolean"), "score")
    assert {r.product_name: (r.tier, r.top, r.lead) for r in found.collect()} == {"a": ("exact", 1.0, 1.0), "b": ("ambiguous", 0.9, 0.01), "c": ("strong", 0.98, 0.98), "d": ("possible", 0.98, 0.98), "e": ("none", 0.0, 0.0), "f": ("possible", 0.3, 0.3)}


def test_suppliers_by_position_and_without_header(spark, tmp_path):
    (tmp_path / "TradexOld.csv").write_text("x\n")
    line = lambda code, name, price, status, warranty, oid: f"{code},{name},{price},,5,,{status},,,art,{warranty},,,cat,{oid}\n"
    (tmp_path / "TradexPrice.csv").write_text("head\n" + line("7.0", "SSD", "10", "В наличии", "12", "99.0") + line("7", "again", "5", "В наличии", "1", "") + line("8", "HDD", "x", "В наличии", "1", "") + line("9", "RAM", "3", "нет", "1", ""))
    path = suppliers.newest_file(spark, str(tmp_path), suppliers.LAYOUTS["Tradex"].files)
    assert path.endswith("TradexPrice.csv") and suppliers.newest_file(spark, str(tmp_path), "none*") is None
    rows = suppliers.positioned(suppliers.read_cells(spark, path), suppliers.LAYOUTS["Tradex"], "Tradex").collect()
    assert [(r.supplier, r.supplier_code, r.product_name, r.price, r.warranty, r.product_id) for r in rows] == [("Tradex", "7", "SSD", 10.0, 12, "99")]
    (tmp_path / "plain.csv").write_text("".join(f"{k},K{k},Some long product name {k},{k * 3.5 + 2}\n" for k in range(9)) + "9,K9,No price,0\n")
    found = suppliers.unheadered(suppliers.read_cells(spark, str(tmp_path / "plain.csv")), "P", 4).collect()
    assert len(found) == 9 and (found[2].product_name, found[2].price) == ("Some long product name 2", 9.0)
    assert values(spark, lambda c: suppliers.by_file_name(c, [("trad", "Tradex"), ("price", "TGPC")]), "my-TRADEX-price", "price_bn", "other") == ["Tradex", "TGPC", None]


def test_payload_values(spark):
    assert values(spark, Y.nested_prices, '{"a":{"position_price":{"converted":{"BYN":{"amount":"7"}},"amount":"5,5"},"b":[{"position_price":{"amount":0}}]}}', "[]", None) == [[5.5], [], None]
    renamed = F.create_map(F.lit(" SSD "), F.lit(1), F.lit("ssd"), F.lit(2), F.lit("HDD"), F.lit(3), F.lit(" "), F.lit(4))
    row = spark.range(1).select(Y.normalized_map(renamed, None, lambda k: F.lower(F.trim(k)), {"disk": "ssd", "hdd": "ssd", "none": "no"}).alias("m")).head()
    assert row.m == {"ssd": 2, "hdd": 3, "disk": 2}


def test_cascade_and_import(spark):
    rows = offers(spark, [("S", "1", "7", "bolt", 1.0, 1, None, 1.0, "c", 1), ("S", "2", "8", "nut", 1.0, 1, None, 1.0, "c", 2), ("S", "3", "8", "bolt", 1.0, 1, None, 1.0, "c", 3)])
    cleared, changes = journal.clear_ids(rows, F.col("product_name") == "bolt")
    cache = spark.createDataFrame([("a", "7"), ("b", "8")], "key string, product_id string")
    left, bound = journal.cascade(cleared, changes, cache, cache.toDF("name_key", "bound_id"))
    assert [r.key for r in left.collect()] == ["b"] and [r.bound_id for r in bound.collect()] == ["8"]
    items = spark.createDataFrame([("1", "One", "c")], "product_id string, name string, category string")
    index = spark.createDataFrame([("one", "1")], "name_key string, product_id string")
    new = spark.createDataFrame([("1", "Uno", "c"), ("2", "Two", "d"), ("", "x", "y"), ("3", None, "y")], "product_id string, name string, category string")
    got, names, counts = catalog.import_rows(items, index, new)
    assert sorted(map(tuple, got.collect())) == [("1", "Uno", "c"), ("2", "Two", "d")] and tuple(counts.head()) == (1, 1, 2)
    assert {r.name_key: r.product_id for r in names.collect()} == {"one": "1", "uno": "1", "c uno": "1", "two": "2", "d two": "2"}
    found = catalog.overlap_ids(spark.createDataFrame([("alpha beta gamma",), ("alpha zeta",)], "product_name string"), spark.createDataFrame([("1", "alpha beta"), ("2", "alpha beta delta")], "product_id string, name string"))
    assert {r.product_name: r.found_id for r in found.collect()} == {"alpha beta gamma": "1"}


def test_stream_gives_the_batch_result(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = events.per_window(events.read(spark, str(tmp_path / "in"), source.schema))
    events.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    events.run_once(events.per_window(events.read(spark, str(tmp_path / "in"), source.schema)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start, r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type, r.n) for r in events.per_window(source.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got and got <= want  # the newest windows stay open until the watermark passes them


def test_family_candidates_share_brand_and_model(spark):
    names = spark.createDataFrame([("Palit GeForce RTX 4070 Ti Super 16GB OC",), ("Mouse",), (None,)], "product_name string")
    items = [("1", "Palit RTX 4070 Ti Super 16 GB"), ("2", "Palit RTX 4070 12GB"), ("3", "MSI RTX 4070 Ti Super 16GB"), ("4", "Palit RTX 4070 Ti Super 8GB"), ("5", None)]
    found = review.family_candidates(names, spark.createDataFrame(items, "product_id string, name string"), review.FAMILIES["gpu"])
    assert [(r.product_id, r.score) for r in found.orderBy("rank").collect()] == [("1", 0.94), ("4", 0.78)]


@pytest.mark.parametrize(
    ("family", "name", "same", "other"),
    [
        ("cpu", "AMD Ryzen 5 7600X Box", "AMD Ryzen 5 7600X Tray", "AMD Ryzen 5 7500F Box"),
        ("board", "MSI B650 WiFi DDR5 mATX", "MSI B650 Wi-Fi DDR5 motherboard", "MSI B650 DDR5"),
        ("ram", "Kingston DDR5 2x16GB 6000MHz", "Kingston Fury DDR5 2x16GB", "Kingston DDR4 2x16GB 3200MHz"),
        ("psu", "Chieftec 750W Gold power supply", "Chieftec PSU 750W Gold ATX", "Chieftec 650W Gold"),
        ("hdd", "HDD Toshiba 4TB", "HDD Toshiba P300 4 TB", "HDD Toshiba 6TB"),
        ("cooler", "DeepCool liquid cooler LS720", "DeepCool LS720 AIO", "DeepCool cooler AK400"),
        ("printer", "Printer HP M111w", "HP LaserJet M111w", "HP LaserJet M141w"),
        ("monitor", "Monitor LG 27GP850 27 inch", "LG monitor 27GP850", "LG monitor 32GP850"),
    ],
)
def test_family_keys(spark, family, name, same, other):
    items = spark.createDataFrame([("1", same), ("2", other)], "product_id string, name string")
    found = review.family_candidates(spark.createDataFrame([(name,)], "product_name string"), items, review.FAMILIES[family])
    assert [r.product_id for r in found.collect()] == ["1"]


def test_peripherals(spark):
    items = [("1", "Мышь Logitech G102 Black"), ("2", "Мышь Logitech G102 White"), ("3", "Коврик Logitech G102"), ("4", "Клавиатура Genius"), ("5", "мышь logitech g102")]
    found = review.peripheral_candidates(spark.createDataFrame([("Мышь Logitech G102",), ("Стол",)], "product_name string"), spark.createDataFrame(items, "product_id string, name string"))
    got = {r.product_id: r.score for r in found.collect()}
    assert got.pop("5") == 1.0 and set(got) == {"1", "2"} and all(0.8 <= v < 1 for v in got.values())


def test_closure_follows_chains_and_nulls(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["c", "d", None],), (["x", "y"],), (None,)], "keys array<string>")
    seeds = spark.createDataFrame([("a",), ("lone",), (None,)], "key string")
    assert sorted(r.key for r in categories.closure(rows, seeds).collect()) == ["a", "b", "c", "d", "lone"]


def test_resolve_prefers_in_order(spark):
    rows = spark.createDataFrame([("A", "B", "C", "D", "E"), (" ", "B", "C", "D", "E"), (None, None, "C", "D", "E"), (None, None, "", "D", "vague"), (None, None, None, "D", "E"), (None,) * 5], "a string, b string, c string, d string, e string")
    held = categories.resolve(*[F.col(c) for c in "abcde"], F.col("e") == "vague")
    assert [r.held for r in rows.select(held.alias("held")).collect()] == ["A", "B", "C", "D", "E", None]


def test_replacements_drop_hard_conflicts(spark):
    rows = [("SSD AB-12345678", "1", "SSD AB-12345678", 0.5), ("SSD AB-12345678", "2", "SSD AB-99999999", 0.9), ("SSD AB-12345678", "3", "Foam pad", 0.2)]
    found = review.replacements(spark.createDataFrame(rows, "product_name string, product_id string, name string, score double"))
    assert [(r.product_id, r.score) for r in found.orderBy("rank").collect()] == [("1", 0.925), ("3", 0.2)]


def test_open_entries(spark):
    offers = spark.createDataFrame([("S", "Cable", None, 1), ("S", "Cable", "9", 2), ("S", "Mouse", "8", 1), ("S", "Mouse", None, 2), ("T", "Pad", None, 3)], "supplier string, product_name string, product_id string, pos int")
    queue = spark.createDataFrame([("cable", "S", 1), ("mouse", "S", 2), ("pad", None, 3), ("gone", "S", 4)], "name_key string, supplier string, added int")
    assert [(r.name_key, r.pos) for r in review.open_entries(queue, offers).collect()] == [("gone", None), ("pad", 3), ("mouse", 2)]


def test_candidates_of_names_with_common_tokens_only(spark):
    items = spark.createDataFrame([(str(k), f"red bolt{' xx' if k == 9 else ''}") for k in range(10)] + [("20", "nut")], "product_id string, name string")
    names = spark.createDataFrame([("Red Bolt",), ("bolt xx",), ("zz",), (None,), ("",)], "product_name string")
    found = {(r.product_name, r.product_id): r.overlap for r in matching.token_candidates(names, items, most_common=5).collect()}
    assert found == {("Red Bolt", str(k)): 1.0 for k in range(9)} | {("Red Bolt", "9"): 0.6667, ("bolt xx", "9"): 0.6667}
    whole = {(r.product_name, r.product_id): r.overlap for r in matching.token_candidates(names, items).collect()}
    assert whole == found | {("bolt xx", str(k)): 0.3333 for k in range(9)}


@pytest.mark.parametrize("name", ["catalog_candidates", "match_scores"])
def test_every_product_name_has_candidates_at_sf001(spark, name):
    """No token of the names is rare here."""
    folder = "/root/testdata/sf0.01"
    got = {r.product_name for r in registry.QUERIES[name](spark, folder).select("product_name").distinct().collect()}
    assert got == {r.product_name for r in tables.offers(spark, folder).select("product_name").distinct().collect()}


def test_nearest_offers(spark):
    rows = [("a", 100.0, f"s{k:02}") for k in range(12)] + [("a", 99.0, "t"), ("b", 10.0, "x"), ("b", 10.2, "y"), ("b", 10.3, "z"), ("b", None, "n"), ("c", None, "n")]
    got = {r.product_id: [tuple(x) for x in r.near] for r in market.nearest_offers(spark.createDataFrame(rows, "product_id string, price double, supplier string")).collect()}
    assert got == {"a": [(99.0, "t")] + [(100.0, f"s{k:02}") for k in range(7)], "b": [(10.0, "x"), (10.2, "y")]}


def test_known_ids_without_a_limit(spark):
    from priceloom.operators import ids

    first = spark.createDataFrame([("a", 2), ("b", 1), (None, 0)], "product_id string, pos int")
    second = spark.createDataFrame([("a", 0), ("c", 0)], "product_id string, pos int")
    assert sorted(map(tuple, ids.known_ids([first, second]).collect())) == [("a", 0), ("b", 0), ("c", 1)]
    assert [tuple(r) for r in ids.known_ids([first, second], 2).collect()] == [("b", 0), ("a", 0)]
