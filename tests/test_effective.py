"""Effective categories: preferences case by case, precedence step by step."""

import pytest
from pyspark.sql import functions as F

from priceloom.operators import effective as A


@pytest.mark.parametrize(
    ("name", "current", "inferred", "want"),
    [
        ("Радиатор для SSD M.2", "SSD", "Охлаждение", True), ("Коробка для SSD", "SSD", "Охлаждение", False), ("27 IPS 75Гц", "Периферия", "Монитор", True), ("27 дюймов", "Сеть", "Монитор", False),
        ("Кронштейн NB", "Монитор", "Кронштейны", True), ("x", "БУМАГА", "Бумага и материалы для печати", True), ("[a] DDR4 16GB", "Системный блок", "Оперативная память", True),
        ("Компьютер DDR4 16GB", "Системный блок", "Оперативная память", False), ("Моноблок", "Процессор", "Системный блок", True), ("Мышь", "Периферия", "Мышь", True), ("Колонки", "Наушники", "Акустика", True),
        ("флешка", "usb3.0", "Накопители USB", True), ("Кабель", "Компьютер", "Кабели и переходники", True), ("Мышь", "Мышь", "Мышь", False), ("", "Периферия", "Мышь", False), (None, "Периферия", "Мышь", False), ("Мышь", None, "Мышь", False),
    ],
)
def test_preferences(spark, name, current, inferred, want):
    row = spark.createDataFrame([(name, current, inferred)], "n string, c string, i string")
    assert row.select(A.prefers(F.col("n"), F.col("c"), F.col("i"))).first()[0] is want


@pytest.mark.parametrize(
    ("current", "override", "inferred", "want"),
    [("Наушники", "X", "Акустика", "Акустика"), ("Сеть", "X", "Акустика", "Сеть"), (" ", "Наушники", "Акустика", "Акустика"), (None, "Сеть", "Акустика", "Сеть"), (None, None, "Акустика", "Акустика"), (None, None, None, None)],
)
def test_effective(spark, current, override, inferred, want):
    row = spark.createDataFrame([("Колонки", current, override, inferred)], "n string, c string, o string, i string")
    assert row.select(A.effective(*map(F.col, "ncoi"))).first()[0] == want


@pytest.mark.parametrize(("category", "want"), [("SSD", False), ("USB HUB", True), ("КАБЕЛИ", True), ("КАБЕЛИ И ШНУРЫ", False), ("Кабели", False), ("A", False), (None, False), ("", False), (" WEB ", True)])
def test_raw_categories(spark, category, want):
    assert spark.createDataFrame([(category,)], "c string").select(A.is_raw(F.col("c"))).first()[0] is want


STEPS = "has_id boolean, listed string, exact string, explicit string, strong string, raw_inferred string, override string, repaired string, current string"


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((True, "L", "E", "X", "S", "R", "O", "P", "C"), "L"), ((False, "L", "Ex", "X", "S", "R", "O", "P", "C"), "Ex"), ((True, " ", None, "Chosen", "S", "R", "O", "P", "C"), "Chosen"),
        ((True, None, None, "RAW", "Strong", "R", "O", "P", "Cu"), "Strong"), ((True, None, None, None, None, "R", "O", "P", "Cu"), A.UNSORTED + "Cu"), ((True, None, None, None, None, None, None, None, None), A.UNSORTED + A.NONE),
        ((False, None, None, None, "S", "Inferred", "Over", "P", "RAW"), "Inferred"), ((False, None, None, None, "S", "Inferred", "Over", "P", "Cu"), "Over"), ((False, None, None, None, None, None, "OVER", "Repaired", "Cu"), "Repaired"),
        ((False, None, None, None, None, None, None, None, "Cu"), "Cu"), ((False, None, None, None, None, None, None, None, "RAW"), A.UNSORTED + "RAW"), ((False, None, None, None, None, None, None, None, None), ""),
        ((True, None, None, None, None, None, None, None, A.UNSORTED + "Cu"), A.UNSORTED + "Cu"),
    ],
)
def test_precedence(spark, row, want):
    frame = spark.createDataFrame([row], STEPS)
    assert frame.select(A.precedence(*map(F.col, frame.columns))).first()[0] == want
