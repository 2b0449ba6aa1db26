"""Batches of files: headers, places, bad files, versions; snapshots there and back."""

import random

import pytest
from pyspark.sql import functions as F

from priceloom.sources import batch as B
from priceloom.sources import suppliers as U
from priceloom.sources.tables import read_snapshot, write_snapshot

GOOD = {
    "Tradex_1.csv": 'Прайс от 1 мая\n\nКод,Наименование,Цена,Гарантия\n10.0,"Bolt, long",12.5,6\n10,Bolt again,11,6\n,Bolt without a code,3,\n,Bolt without a code,3,\n11,Nut,0,1\n12,,5,1\n',
    "price_bn_x.csv": "﻿name,price,id\r\nRing,\"1 200,50\",77.0\r\nRod,7,nan\r\n",
    "other 1.csv": "sku,product,цена с ндс,ррц\na1,Gear,100,120\n",
}


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(df):
    return sorted((r.supplier, r.supplier_code or "", r.product_name, r.price, r.warranty, r.product_id, r.rrp) for r in df.collect())


WANT = sorted([
    ("Tradex", "10", "Bolt, long", 12.5, 6, None, None), ("Tradex", "", "Bolt without a code", 3.0, None, None, None), ("Tradex", "", "Bolt without a code", 3.0, None, None, None),
    ("TGPC", "", "Ring", 1200.5, None, "77", None), ("TGPC", "", "Rod", 7.0, None, None, None), ("Mine", "a1", "Gear", 100.0, None, None, 120.0),
], key=str)


def test_a_batch_and_its_report(spark, tmp_path):
    write(tmp_path / "in", GOOD)
    table, pattern = str(tmp_path / "table"), str(tmp_path / "in" / "*.csv")
    report = B.load_batch(spark, pattern, table, [("other", "Mine")])
    assert sorted(map(str, rows(B.current(spark, table)))) == sorted(map(str, WANT))
    assert {r.file.rpartition("/")[2]: (r.supplier, r.rows, r.error) for r in report.collect()} == {"Tradex_1.csv": ("Tradex", 3, None), "price_bn_x.csv": ("TGPC", 2, None), "other 1.csv": ("Mine", 1, None)}
    assert B.current(spark, table).filter("supplier = 'Unknown'").isEmpty()


@pytest.mark.parametrize(
    ("name", "text", "why"),
    [("bad.csv", "a,b\n1,2\n", "no header"), ("bad.csv", "", "no header"), ("bad.csv", "name,price\nx,0\n", "no rows"), ("bad.csv", "name,price\nx,1\n".encode() + "Товар,2\n".encode("cp1251"), "corrupt"), ("bad.csv", 'name,price\n"x,1\ny,2\n', "corrupt")],
)
def test_a_bad_file_leaves_the_old_table(spark, tmp_path, name, text, why):
    write(tmp_path / "in", GOOD)
    table, pattern = str(tmp_path / "table"), str(tmp_path / "in" / "*.csv")
    B.load_batch(spark, pattern, table)
    before = rows(B.current(spark, table))
    write(tmp_path / "in", {name: text})
    with pytest.raises(B.BatchError, match=f"{name}: .*{why}"):
        B.load_batch(spark, pattern, table)
    assert rows(B.current(spark, table)) == before
    write(tmp_path / "in", {name: "name,price\nx,1\n"})
    B.load_batch(spark, pattern, table)
    assert len(rows(B.current(spark, table))) == len(before) + 1


def test_unfinished_versions_do_not_count(spark, tmp_path):
    table = str(tmp_path / "table")
    assert B.current(spark, table) is None
    B.commit(spark.range(3).toDF("x"), table)
    (tmp_path / "table" / "v-000000002").mkdir()
    assert B.current(spark, table).count() == 3
    B.commit(spark.range(5).toDF("x"), table)
    assert B.current(spark, table).count() == 5


def test_large_files_are_read_in_parts(spark, tmp_path):
    text = "intro\ncode,name,price\n" + "".join(f"{k % 4000},thing {k},{k + 1}\n" for k in range(9000))
    write(tmp_path / "in", {"tradex.csv": text})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = B.read_batch(spark, str(tmp_path / "in" / "*.csv")).offers
        assert got.count() == 4000
        assert got.filter("price <> supplier_code + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tasks_without_rows_make_no_files(spark, tmp_path):
    """Where the table is read in more parts than it has rows for, the batch of the query has no file of a header only."""
    from priceloom.plans import changes
    from tests.conftest import SF

    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = changes.batch_of_files(spark, SF).agg(F.sum("n")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_extendedprice > 0").count()


def test_lines_without_quotes_are_split(spark):
    """Splitting gives what the parser gives, null for a blank cell apart."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab ,,\\;#\t'ж") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["x" + "," * 60, '"a,b",c', ' "a" ,""']
    parsed = F.from_csv("value", ", ".join(f"c{k} string" for k in range(40)), {"sep": ",", "mode": "PERMISSIVE"})
    given = spark.createDataFrame([(t,) for t in lines], "value string").select("value", B.cells_of(F.col("value"), ",").alias("cells"), parsed.alias("parsed"))
    for r in given.collect():
        cells = [*r.cells, *[None] * (40 - len(r.cells))]
        assert [c or None for c in cells] == [c or None for c in r.parsed], r.value


def test_rows_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Codes that come again are looked up by themselves; the first row of each stays, also in another part of the file."""
    plans = []
    kept = B.stored
    monkeypatch.setattr(B, "stored", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df))
    text = "intro\ncode,name,price\n" + "".join(f'{k % 4000}{".0" if k % 3 else ""},{chr(34)}thing, {k}{chr(34)},{k + 1}\n' if k % 2 else f"{k % 4000},thing {k},{k + 1}\n" for k in range(9000)) + ",no code,5\n,no code,5\n"
    write(tmp_path / "in", {"tradex.csv": text, "iven.csv": "код,товар,цена\n1,a,1\n1,b,2\n2,,3\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = B.read_batch(spark, str(tmp_path / "in" / "*.csv")).offers.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("Tradex", str(k), f"thing, {k}" if k % 2 else f"thing {k}", k + 1.0) for k in range(4000)] + [("Tradex", None, "no code", 5.0)] * 2 + [("IVEN", "1", "a", 1.0)]
    assert sorted((r.supplier, r.supplier_code, r.product_name, r.price) for r in got if r.supplier_code) == sorted(w for w in want if w[1]) and len(got) == len(want)
    mine = [plan for columns, plan in plans if "rrp" in columns and "at" in columns]
    assert mine and not any("Aggregate" in p for p in mine)


@pytest.mark.parametrize(
    ("path", "rules", "want"),
    [("file:/x/N_Tech june.csv", (), "N-Tech"), ("/a/iven zakaz.csv", (), "IVEN_zakaz"), ("/a/IVEN.csv", (), "IVEN"), ("/a/1030ZpriceBN.csv", (), "BN-1030Z"), ("/a/1030p.csv", (), "BN-1030"), ("/tradex/part-1.csv", (), "Tradex"), ("/a/x.csv", (), None), ("/a/iven.csv", [("", "No"), ("IVEN", "n tech")], "N-Tech"), ("/a/zz.csv", [("zz", "Own")], "Own"), (None, (), None)],
)
def test_suppliers_of_files(spark, path, rules, want):
    assert spark.createDataFrame([(path,)], "p string").select(U.supplier_of_file(F.col("p"), rules)).first()[0] == want


def test_snapshots_there_and_back(spark, tmp_path):
    offers = spark.createDataFrame([("1", "a, \"b\"", 1.005, 3), (None, "c", float("inf"), None), ("2", None, float("nan"), 0)], "product_id string, product_name string, price double, row_idx int")
    write_snapshot(offers, str(tmp_path / "s"))
    got = sorted((r.product_id, r.product_name, r.price, r.row_idx, r.supplier) for r in read_snapshot(spark, str(tmp_path / "s")).collect())
    assert got == [("", "c", None, None, ""), ("1", 'a, "b"', 1.01, 3, ""), ("2", "", None, 0, "")] or got == [("", "c", None, None, ""), ("1", 'a, "b"', 1.0, 3, ""), ("2", "", None, 0, "")]
    (tmp_path / "o.json").write_text('{"data": [["1", "x", 2.5],\n ["2"]]}')
    assert [(r.product_id, r.product_name, r.price, r.category) for r in read_snapshot(spark, str(tmp_path / "o.json")).collect()] == [("1", "x", 2.5, None), ("2", None, None, None)]
