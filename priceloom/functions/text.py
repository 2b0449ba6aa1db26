"""Normalisers and tokenisers for offer texts, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for a missing id.
BLANK_IDS = ("", "nan", "none")


def strip(value: Column) -> Column:
    """Without white space at either end; Spark's trim takes spaces only."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def normalize_id(value: Column) -> Column:
    """The id as text, null if blank; one trailing ".0" goes."""
    text = F.regexp_replace(strip(value.cast("string")), r"\.0$", "")
    return F.when(~F.lower(text).isin(*BLANK_IDS), text)


def name_key(name: Column) -> Column:
    """Lower case, without a leading [tag], white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s*\[[^\]]*\]", ""), r"(?U)\s+", " "))


def compact_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^0-9a-zа-яё]+", "")


def words(name: Column, shortest: int = 2) -> Column:
    """The distinct words of a name in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit("([0-9a-zа-яё]+)")), lambda t: F.length(t) >= shortest))


def capacity_tokens(name: Column) -> Column:
    """Sizes such as 1tb or 500gb, without a fraction of zeros; a kit of 2 x 16 gb is one of 32gb."""
    low = F.regexp_replace(F.lower(name), ",", ".")
    kit = r"\b([0-9]{1,2})\s*[xх]\s*([0-9]+(?:\.[0-9]+)?)\s*gb\b"
    bare = lambda n: F.regexp_replace(n, r"\.0+$|(\.[0-9]*?)0+$", "$1")
    part = lambda text, pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    kits = F.zip_with(part(low, kit, 1), part(low, kit, 2), lambda n, size: F.concat(bare((n.cast("double") * size.cast("double")).cast("string")), F.lit("gb")))
    single = r"([0-9]+(?:\.[0-9]+)?)\s*(tb|gb)"
    rest = F.regexp_replace(low, kit, " ")
    singles = F.zip_with(part(rest, single, 1), part(rest, single, 2), lambda n, unit: F.concat(F.when(n.contains("."), bare(n)).otherwise(n), unit))
    return F.array_sort(F.array_distinct(F.concat(kits, singles)))


def article_tokens(name: Column, shortest: int = 8) -> Column:
    """Words of letters, digits and dashes that are long enough and hold a digit."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.upper(name), F.lit("([0-9A-Z][0-9A-Z#-]+)")), lambda t: (F.length(t) >= shortest) & t.rlike("[0-9]")))


def supplier_token(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(name)), r"[\s/-]+", "_"), "_+", "_")


def delivery_days(text: Column) -> Column:
    """The first whole number of the text, "2" if there is none."""
    days = F.regexp_extract(F.coalesce(text, F.lit("")), "([0-9]+)", 1)
    return F.when(days == "", F.lit("2")).otherwise(days)


def money(text: Column) -> Column:
    """A price from text: blanks and no-break spaces go, a comma is a point; null unless finite; two digits."""
    return rounded(number(text))


def number(text: Column) -> Column:
    return F.translate(text, ", \t\n\x0b\f\r\u00a0", ".").try_cast("double")


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def rounded(value: Column) -> Column:
    return F.when(finite(value), F.round(value, 2))
