"""Which category an offer has in the end: preferences of the inferred one, and the precedence of all that say something.

All are column expressions. Null and blank categories say nothing; null names fit no preference.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.functions import text as X

# Where the inferred category goes before the current one. Inferred ones, current ones (None: any other), and parts of
# the name of which one must be there (None: none need be).
PREFERENCES = (
    (("Охлаждение",), ("SSD", "Накопители USB", "Монитор"), ("радиатор", "охлажд", "термопаст")),
    (("Монитор",), None, ("монитор", "ips", "hdmi", "displayport", "гц", "hz")),
    (("Кронштейны",), ("Монитор", "Периферия", "Аксессуары"), ("кронштейн",)),
    (("Бумага и материалы для печати",), ("БУМАГА",), None),
    (("Аксессуары для серверов",), ("АКСЕССУАРЫ",), None),
    (("Системный блок",), ("Видеокарта", "SSD", "Процессор", "Оперативная память", "Компьютер"), ("компьютер", "моноблок", "системный блок", "пэвм tgpc")),
    (("Периферия",), ("Накопители USB", "WEB", "РАЗВЕТВИТЕЛЬ"), ("web камера", "webcam", "dvdrw")),
    (("USB-хабы",), ("Периферия", "Кабели и переходники", "РАЗВЕТВИТЕЛЬ"), ("usb-хаб", "usb hub", "док-станц", "разветвитель usb")),
    (("Кабели и переходники",), ("Периферия", "Накопители USB", "РАЗВЕТВИТЕЛЬ"), ("разветвитель usb", "us158", "30345")),
    (("Клавиатура",), ("Накопители USB", "НАБОР"), ("набор",)),
    (("SSD", "Жесткий диск"), ("Накопители USB",), ("ssd", "hdd", "жестк", "винчестер")),
    (("Охлаждение", "Периферия", "Клавиатура", "Мышь", "Наушники", "Сеть", "Сверла и буры", "Строительный, слесарный, монтажный инструмент", "Наборы инструментов", "Наборы электроинструмента"), ("Кабели и переходники",), None),
    (("Клавиатура", "Мышь", "Монитор"), ("Периферия",), None),
    (("Акустика",), ("Наушники",), None),
    (("Системный блок", "Аксессуары"), ("SSD",), None),
    (("Системный блок", "Кабели и переходники"), ("Компьютер",), None),
)
# Kinds of USB that are no category; what tells memory of its own from a computer with memory.
USB_KINDS = ("USB2", "USB3", "USB2.0", "USB3.0", "USB3.1", "USB3.2")
MEMORY = r"(?U)\bddr[345]\b|оперативн|\bram\b|so[\s\-]?dimm|\bdimm\b"
COMPUTER = r"(?U)\bкомпьютер\b|системный\s+блок|\bпэвм\b|\btgpc\b|iven\s+(?:by|gaming|office|home|pro|ultra)|\bcore\s+i[3579]\b|\bryzen\b"
# Short categories in capitals that are none of a supplier's own, and what stands before a category that is to be sorted.
NO_RAW, UNSORTED, NONE = ("SSD", "HDD", "ИБП", "БП", "NAS"), "Требует сортировки · родитель: ", "Без категории"


def filled(category: Column) -> Column:
    trimmed = X.strip(category)
    return F.when(trimmed != "", trimmed)


def prefers(name: Column, current: Column, inferred: Column) -> Column:
    """Whether the inferred category goes before the current one."""
    low, own, other = F.lower(X.strip(name)), filled(current), filled(inferred)
    bare = F.trim(F.regexp_replace(low, r"^\[[^\]]+\]\s*", ""))
    tests = []
    for inferred_, current_, parts in PREFERENCES:
        test = other.isin(*inferred_)
        if current_ is not None:
            test &= own.isin(*current_)
        if parts is not None:
            test &= reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
        tests.append(test)
    tests.append((other == "Оперативная память") & (own == "Системный блок") & bare.rlike(MEMORY) & ~bare.rlike(COMPUTER))
    tests.append((other == "Накопители USB") & F.upper(own).isin(*USB_KINDS))
    found = reduce(lambda a, b: a | b, tests)
    return F.coalesce((own != other) & (low != "") & found, F.lit(False))


def effective(name: Column, current: Column, override: Column, inferred: Column) -> Column:
    """The current category, else the override, else the inferred one; the inferred one before the first two where it is preferred."""
    said = F.coalesce(filled(current), filled(override))
    return F.when(said.isNull() | prefers(name, said, inferred), filled(inferred)).otherwise(said)


def is_raw(category: Column) -> Column:
    """Whether a category looks like a supplier's own: one or two words in capitals."""
    text = X.strip(category)
    shaped = text.rlike(r"^[A-ZА-ЯЁ0-9\s\-+/_.]+$") & (F.size(F.split(text, r"\s+")) <= 2) & (F.length(text) >= 2)
    return F.coalesce(shaped & ~text.isin(*NO_RAW), F.lit(False))


def unsorted(category: Column) -> Column:
    """The category under which an offer waits to be sorted, below its present one."""
    text = X.strip(F.coalesce(category, F.lit("")))
    parent = X.strip(F.when(text.startswith(UNSORTED), F.substring(text, len(UNSORTED) + 1, 1 << 20)).otherwise(text))
    return F.concat(F.lit(UNSORTED), F.when(parent == "", NONE).otherwise(parent))


def precedence(has_id: Column, listed: Column, exact: Column, explicit: Column, strong: Column, raw_inferred: Column, override: Column, repaired: Column, current: Column) -> Column:
    """The category that holds, first that says something:

    that of the offer's id in the catalog; that of its exact name; one chosen by hand; with an id, one that the name surely tells,
    else it waits to be sorted; for a supplier's own category, one inferred from the name; the override; the repaired one; the
    current one. Chosen ones and overrides that look like a supplier's own say nothing, and what looks so in the end waits to be sorted.
    """
    own = lambda c: F.when(~is_raw(c), filled(c))
    holds = F.coalesce(
        F.when(has_id, filled(listed)), filled(exact), own(explicit), F.when(has_id, F.coalesce(filled(strong), unsorted(current))),
        F.when(is_raw(current), filled(raw_inferred)), own(override), filled(repaired), filled(current), F.lit(""),
    )
    return F.when(is_raw(holds), unsorted(holds)).otherwise(holds)
