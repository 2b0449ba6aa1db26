"""What a product name says of the product: codes, models, sizes, colours, packs, as column expressions.

Patterns see letters of any script. Arrays are distinct. Nothing here is a UDF.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.functions import text as X

# Words of names and what they stand for.
COLOURS = {
    "black": "black черный чёрный черн blk bk", "white": "white белый wht wh", "silver": "silver grey gray серый серебристый серебро",
    "blue": "blue синий голубой", "red": "red красный", "green": "green зеленый зелёный", "gold": "gold золотой золото", "yellow": "yellow желтый жёлтый",
    "orange": "orange оранжевый", "purple": "purple violet фиолетовый", "pink": "pink розовый", "brown": "brown коричневый",
}
COLOUR_WORDS = (
    "black white blue red green grey gray silver gold черный чёрный белый синий голубой красный зеленый зелёный серый серебристый "
    "золотой желтый жёлтый orange pink purple"
).split()
STOP_WORDS = "для с и на по ret rtl oem box".split() + COLOUR_WORDS
GENERIC = (
    "беспроводная беспроводной беспроводное wireless проводная проводной wired игровая игровой gaming гарнитура наушники headset headphones "
    "мышь мышка mouse клавиатура keyboard колонки колонка акустика speakers черный чёрный белый синий красный зеленый зелёный "
    "black white blue red green grey gray pink purple"
).split()
MODIFIERS = "plus nano mini max pro ultra digital ex rgb argb".split()
SPEC_PREFIXES = "SFF SAS SATA SASATA PCIE PCIEX M2 USB HDMI DISPLAYPORT THUNDERBOLT DIMM SODIMM DDR LPDDR ATX EPS NVME OCU OCULINK SOC SOCKET LGA WIFI LAN BT ARGB RGB RAID".split()
UNITS = "MM CM M W V A MHZ GHZ TB GB MB KB DPI PPI RPM HZ BIT BITS MS NM G KG LM".split()
BRANDS_LIKE_CODES = "a4tech 1stplayer 2power 2e 3q 4gamers 5bites".split()
NOISE = "am atx cl ddr dpi gb gbe ghz hz lga lpddr mb mbps mhz mm nvme pc pcie rpm sata tb usb w".split()
RATES = "1200 1600 1800 2400 2800 3200 3600".split()
#: Forms under which names begin with the kind of product; the forms of a line are one kind.
KINDS = """
бп, блок питания, блоки питания, psu, power supply
ибп, источник бесперебойного питания, ups
мфу, multifunctional, принтер-сканер
принтер, printer
сканер, scanner
монитор, monitor, дисплей, display
клавиатура, keyboard
мышь, мышка, mouse
гарнитура, наушники, headset, headphones
колонки, колонка, акустика, speakers
корпус, case
кулер, cooler, охладитель, cooling, кулер для процессора, процессорный кулер
видеокарта, видеоадаптер, gpu, graphics
процессор, cpu, processor
материнская плата, материнка, motherboard, mainboard
оперативная память, память ddr, озу, ram
ssd, ссд накопитель, твердотельный накопитель
hdd, жесткий диск, жёсткий диск, hdd накопитель
ноутбук, laptop, notebook
моноблок, all in one, all-in-one, aio pc
планшет, tablet
смартфон, телефон, phone, smartphone
кабель, cable, шнур, провод
разветвитель, разветвитель для, хаб, hub, splitter, usb-хаб, usb хаб, usb-hub
dok-stantsiya, dok stantsiya, dock station, док-станция, док станция
адаптер, adapter, переходник, конвертер
флеш, флешка, usb накопитель, usb flash
роутер, маршрутизатор, router, wi-fi роутер
коммутатор, switch, свитч
зарядное устройство, сзу, зарядка, charger
источник питания, блок питания для ноутбука
стабилизатор, стабилизатор напряжения
термопаста, термопрокладка, thermal paste
кронштейн, крепление, bracket, mount
внешний накопитель, внешний жесткий диск, portable hdd
картридж, cartridge, тонер
веб-камера, вебкамера, webcam, web-cam, web cam
микрофон, microphone
удлинитель, сетевой фильтр, surge protector
охлаждающая подставка, подставка для ноутбука
система охлаждения, водяное охлаждение, сжо, aio cooler
вентилятор, fan, корпусной вентилятор
память, модуль памяти
"""
CABLE_KINDS = ("кабель", "адаптер", "разветвитель")
#: Words before the brand that are not the brand.
NO_BRAND = (
    "hdd ssd sata sataii sataiii usb usba usbc typea typec ddr3 ddr4 ddr5 pc pcie nvme bulk tb gb mb mhz hz rpm mm cl dp dvi hdmi vga displayport minidp microdp "
    "microusb usbmicro jack male female atx matx eatx itx microatx miniitx minitower без для под про как из по на со за desktop mini midi tower slim ultra "
    "соединительный аудио стерео медь бп ибп мфу узу сзу корпус корпуса кейс кейса игровая игровой игровое беспроводная беспроводной офисная офисный офисное office "
    "проводная проводной механическая механический мембранная мембранный оптическая оптический лазерная лазерный ультратонкая ультратонкий портативная портативный "
    "внешний внешняя встроенный встроенная цветной цветная монохромный монохромная мышь мышка клавиатура гарнитура наушники микрофон микрофоном монитор монитора "
    "мониторов жк кронштейн кронштейны принтер сканер колонки колонка акустика камера ноутбук ноутбука планшет смартфон телефон роутер коммутатор адаптер переходник "
    "кабель шнур разветвитель вентилятор кулер охладитель стабилизатор комплект комплекта набор набора вентиляторов сумка сумки сумку чехол чехла рюкзак накопитель "
    "накопители источник бесперебойного питания micro microsd sd sdhc sdxc карта карты памяти"
).split()
BOARD_BRANDS = "asrock|gigabyte|asus|msi|biostar|colorful|maxsun"
BOARD_FEATURES = {"wifi": r"wi[\s-]?fi", "gamingx": r"gaming\s*x", "aorus": r"\baorus\b", "elite": r"\belite\b", "ds3h": r"\bds3h\b", "d3hp": r"\bd3hp\b", "d2h": r"\bd2h\b", "eagle": r"\beagle\b", "ice": r"\bice\b"}
FAN_SERIES = (r"\b(crystal)\s*(120|140)(?:\s+(white|black|snow|бел\w*|черн\w*))?", r"\b(ice\s*fan)\s*(120|240|360)(?:\s+argb)?(?:\s+(snow|white|black|бел\w*|черн\w*))?", r"\b(boreas)\s*(120|140)(?:\s+(white|black|бел\w*|черн\w*))?")
VIDEO = r"\b(rx|gtx|rtx|r[0-9]|hd|vega|arc)\s+(\d{3,4})\s*(xtx|xt|ti|super|m|s)?\b"
APPLE = r"\b(?:apple|macbook|iphone|ipad|imac|mac\s+mini|airpods)\b"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What the group of the pattern matches, every time; letter case aside."""
    return F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(group))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-zа-я0-9]+", "")


def _is_code(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[a-zа-яё]")


def _is_spec(token: Column) -> Column:
    """Interfaces, sockets and the like (token: compact)."""
    return token.rlike(f"^(?:[0-9]+(?:gbe|g)$|{'|'.join(p.lower() for p in SPEC_PREFIXES)})")


def distinct(*arrays: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*arrays), lambda t: t != ""))


def words(text: Column) -> Column:
    return found(F.lower(text), "([a-zа-я0-9]+)")


def name_tokens(name: Column) -> Column:
    """Words of three characters and more, without colours and fillers; 750w gives 750 too."""
    with_numbers = F.flatten(F.transform(words(name), lambda w: F.when(w.rlike("^[0-9]{2,4}(?:w|mhz|gb|tb|mm)$"), F.array(w, F.regexp_extract(w, "^([0-9]+)", 1))).otherwise(F.array(w))))
    return F.array_distinct(F.filter(with_numbers, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS)))


def match_text(name: Column) -> Column:
    """Words of a name in lower case; parentheses that hold only colours go."""
    colours = "|".join(COLOUR_WORDS)
    bare = F.regexp_replace(F.lower(name), rf"\(\s*(?:(?:{colours})[\s,/-]*)+\)", " ")
    return F.trim(F.regexp_replace(bare, "[^a-zа-я0-9]+", " "))


def important_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(words(name), lambda t: (F.length(t) >= 3) & ~t.isin(*GENERIC) & ~t.rlike("^[0-9]+$")))


def colours(name: Column) -> Column:
    own = F.split(F.regexp_replace(F.lower(name), "[^a-zа-яё0-9]+", " "), " ")
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(own, F.array(*map(F.lit, forms.split()))), colour) for colour, forms in COLOURS.items()]))


def modifiers(name: Column) -> Column:
    return F.array_intersect(F.split(F.regexp_replace(F.lower(name), "[^a-zа-яё0-9]+", " "), " "), F.array(*map(F.lit, MODIFIERS)))


def connections(name: Column) -> Column:
    kinds = {"ps2": r"\bps\s*[/.-]?\s*2\b", "usb": r"\busb(?:\s*[- ]?\s*[abc])?\b", "bluetooth": r"\bbluetooth\b|\bbt\s*\d", "wireless24": r"\b2[.,]4\s*(?:ghz|ггц)\b"}
    return F.array_compact(F.array(*[F.when(has(name, pattern), kind) for kind, pattern in kinds.items()]))


def kind(name: Column) -> Column:
    """The first form of the kind that the name begins with, by its first three, two or one words."""
    forms = [(form.strip(), line.split(",")[0].strip()) for line in KINDS.strip().split("\n") for form in line.split(",")]
    known = F.create_map(*[F.lit(x) for pair in dict(forms).items() for x in pair])
    own = F.split(F.lower(X.strip(name)), r"[\s,.(]+")
    return F.coalesce(*[F.try_element_at(known, F.array_join(F.slice(own, 1, n), " ")) for n in (3, 2, 1)])


def brand(name: Column) -> Column:
    """The first word without digits that is no kind, form or filler, compact."""
    own = F.split(F.lower(X.strip(name)), r"[\s,.(]+")
    forms = [form.strip() for line in KINDS.strip().split("\n") for form in line.split(",")]
    skip = reduce(lambda out, n: F.when(F.array_join(F.slice(own, 1, n), " ").isin(*[f for f in forms if f.count(" ") == n - 1]), n).otherwise(out), (1, 2, 3), F.lit(0))
    tokens = F.transform(found(name, "([a-zа-я][a-zа-я0-9.+_-]+)"), compact)
    good = lambda t, i: (t != "") & ~t.isin(*NO_BRAND) & ~t.rlike("[0-9]") & ~t.rlike("^(?:dp|hdmi|dvi|usb|usba|usbc|typea|typec|jack|displayport)+$") & (i >= skip)
    return F.get(F.filter(tokens, good), F.lit(0))


def strict_articles(name: Column) -> Column:
    """Articles of forms that name one product: 90NR.ABCD1.001, 7D25-001XRU, 9S6-17K4-001."""
    forms = (r"\b([a-z0-9]{2,4}\.[a-z0-9]{4,8}\.[a-z0-9]{3})\b", r"\b(\d{1,2}[a-z]{1,3}-\d{3}xru)\b", r"\b(9s6-[a-z0-9]{4,8}-[a-z0-9]{3,4})\b")
    return F.filter(distinct(*[F.transform(found(name, p), compact) for p in forms]), lambda t: (F.length(t) >= 7) & _is_code(t))


def variants(name: Column) -> Column:
    """Words that mix letters and digits and are no measure: models and their variants."""
    low = F.lower(name)
    tokens = F.transform(F.concat(found(low, "([a-zа-яё0-9]+)"), found(low, "([a-z0-9]+(?:[-_/][a-z0-9]+)+)")), compact)
    letters = lambda t: F.regexp_replace(t, "[0-9]+", "")
    fits = lambda t: (F.length(t) >= 3) & _is_code(t) & ~letters(t).isin(*NOISE) & ~letters(t).rlike("^(?:ddr|pcie|sata|usb)") & ~t.rlike("^[0-9]+(?:gb|tb|mb|w|hz|ghz|mhz|mm|rpm|mbps)$")
    return F.array_distinct(F.filter(tokens, fits))


def signature(token: Column) -> Column:
    return F.regexp_replace(token, "[0-9]+", "#")


def variants_conflict(a: Column, b: Column) -> Column:
    """Whether both have variants of one signature (letters, with # for numbers), but none in common."""
    plain = lambda x: F.filter(x, lambda t: F.length(F.regexp_replace(signature(t), "[^#]", "")) <= 2)
    signs = lambda x: F.array_distinct(F.transform(x, signature))
    return F.size(F.array_except(F.array_intersect(signs(plain(a)), signs(plain(b))), signs(F.array_intersect(plain(a), plain(b))))) > 0


def numeric_codes(name: Column) -> Column:
    return distinct(F.transform(found(name, r"\b(\d{3}[- ]\d{6})\b"), lambda t: F.regexp_replace(t, "[^0-9]", "")))


def pc_code(name: Column) -> Column:
    """The number of an assembled computer, as in 12345 A-X."""
    code = F.regexp_extract(name, r"(?iU)\b(\d{4,6})\s*[A-ZА-Яa-zа-я]-[Xx]\b", 1)
    return F.when(code != "", code)


def gpu(name: Column) -> Column:
    raw = match_text(name)
    one = lambda p, n: F.when(raw.rlike(p), F.upper(F.concat(*[F.regexp_extract(raw, p, k) for k in range(1, n + 1)])))
    return F.coalesce(one(r"\b(rtx|gtx)\s*(\d{3,4})\s*(ti|super)?\b", 3), one(r"\b(rx)\s*(\d{3,4})\s*(xtx|xt|gre)?\b", 3), one(r"\b(arc)\s+(a\d{3})\b", 2))


def board(name: Column) -> Column:
    """brand, model, chipset and features of a motherboard; null for other products."""
    is_board = has(name, r"^\s*mb\b|\bматеринск\w*\s+плат\w*\b|\bmotherboard\b|\bmainboard\b")
    low = F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)^\s*mb\s+", ""), r"(?U)^\s*(?:материнск\w*\s+плат\w*|motherboard|mainboard)\s+", "")
    maker = F.regexp_extract(low, rf"(?U)\b({BOARD_BRANDS})\b", 1)
    head = F.element_at(F.split(F.regexp_replace(low, rf"(?U)^\s*(?:{BOARD_BRANDS})\s+", ""), r"(?U)\b(?:socket|soc)[-\s]?[a-z0-9-]+\b|\s*\(rev\.|\s*,", 2), 1)
    head = F.regexp_replace(head, r"\([^)]+\)", " ")
    features = F.array_compact(F.array(*[F.when(has(head, p), f) for f, p in BOARD_FEATURES.items()]))
    chipset = F.regexp_extract(head, r"\b([a-z]\d{3,4}[a-z]?)\b", 1)
    return F.when(is_board & (compact(head) != ""), F.struct(maker.alias("brand"), compact(head).alias("model"), chipset.alias("chipset"), features.alias("features")))


def fan_pack(name: Column) -> Column:
    """How many fans are in a pack, 0 where the name is no fan's or does not say."""
    low = F.lower(name)
    number = lambda p: F.when(has(low, p), F.regexp_extract(low, f"(?iU){p}", 1).cast("int"))
    said = F.coalesce(F.when(has(low, r"\btrio\b|трио"), 3), number(r"набор\s*(\d{1,2})\s*(?:в|in)\s*1"), number(r"\b\d{2,3}\s*[xх]\s*(\d{1,2})\b"), number(r"\b[xх](\d{1,2})\b"), F.when(has(low, r"\bкомплект(?:\s+вентиляторов)?\b"), 2), F.lit(0))
    return F.when(has(low, "вентилятор|fan|vento"), said).otherwise(0)


def fan_series(name: Column) -> Column:
    bases = [F.zip_with(F.transform(found(name, p, 1), compact), found(name, p, 2), lambda a, b: F.concat(a, b)) for p in FAN_SERIES]
    full = [F.zip_with(base, F.transform(found(name, p, 3), compact), lambda a, b: F.concat(a, b)) for base, p in zip(bases, FAN_SERIES, strict=True)]
    return distinct(*bases, *full)


def articles(name: Column) -> Column:
    """Articles: in parentheses, or any word of eight characters and more with a digit; sockets are none."""
    inner = F.flatten(F.transform(found(name, r"\(([^)]+)\)"), lambda p: F.concat(F.array(p), F.split(p, r"[\s,;/|]+"))))
    tokens = F.transform(F.concat(inner, found(name, r"([a-z0-9][a-z0-9\-._/]{7,})")), lambda t: F.upper(F.trim(t)))
    fits = lambda t: t.rlike(r"^[A-Z0-9][A-Z0-9\-._/#]{7,}$") & t.rlike("[0-9]") & ~t.rlike("^(?:SOCKET|SOC|LGA|AM[0-9]|S?TR[0-9X])")
    return F.filter(tokens, fits)


def article(name: Column) -> Column:
    return F.get(articles(name), F.lit(0))


def numeric_models(name: Column) -> Column:
    """Numbers that name a model: in parentheses, or after a bag or case."""
    inner, bag = found(name, r"\(\s*(\d{3,6})\s*\)"), found(name, r"\b(?:сумк\w*|чехл\w*|рюкзак\w*|bag|case)\b.{0,120}?\b(\d{3,6})\b")
    return F.filter(distinct(inner, bag), lambda t: ~t.isin(*RATES))


def apple_articles(name: Column) -> Column:
    tokens = F.transform(F.concat(found(name, r"\b([a-z0-9]{5})[a-z]{2}/[a-z]\b"), found(name, r"\b([a-z0-9]{5})(?=[\s)\],;:/-]|$)")), compact)
    return F.when(has(name, APPLE), F.filter(F.array_distinct(tokens), lambda t: (F.length(t) == 5) & _is_code(t) & ~t.rlike("^a[0-9]{4}$"))).otherwise(F.array().cast("array<string>"))


def _paren_articles(name: Column) -> Column:
    return F.filter(F.transform(found(name, r"\(\s*([a-z][a-z0-9.\-/]{5,})\s*\)"), compact), lambda t: _is_code(t) & ~_is_spec(t))


def _joined(name: Column, pattern: str, groups: int) -> Column:
    parts = [F.transform(found(name, pattern, k), compact) for k in range(1, groups + 1)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), parts)


def article_likes(name: Column) -> Column:
    """Words that look like articles or models: five characters and more, letters and digits, no measure, no interface."""
    raw = found(name, r"([a-z0-9][a-z0-9._\-/]{3,})")
    parts = F.flatten(F.transform(raw, lambda t: F.concat(F.array(t), F.split(t, "[-/]"))))
    tokens = F.concat(_paren_articles(name), F.transform(parts, compact), _joined(name, VIDEO, 3), F.transform(found(name, r"\b([a-z]{1,4}-?\d{3,5}[a-z]{0,3})\b"), compact), F.array(compact(F.coalesce(article(name), F.lit("")))))
    apple = has(name, APPLE)
    units = "|".join(u.lower() for u in UNITS)
    fits = lambda t: (F.length(t) >= 5) & _is_code(t) & ~_is_spec(t) & ~t.isin(*BRANDS_LIKE_CODES) & ~t.rlike(f"^[0-9]+(?:{units})$") & ~t.rlike("^[0-9]+x[a-z]") & ~(apple & t.rlike("^a[0-9]{4}$"))
    return distinct(F.filter(tokens, fits), apple_articles(name))


def model_hints(name: Column) -> Column:
    """article_likes, fan series and shorter words of letters and digits; of each also its beginning of letters, number and suffix."""
    inner = F.flatten(F.transform(found(name, r"\(([^()]*)\)"), lambda p: F.transform(found(p, r"([a-z0-9][a-z0-9._\-/]{3,})"), compact)))
    short = F.filter(F.concat(inner, name_tokens(name)), lambda t: (F.length(t) >= 4) & _is_code(t) & ~_is_spec(t) & ~t.rlike("^[0-9]+x[a-z]"))
    tokens = F.filter(distinct(article_likes(name), fan_series(name), short), lambda t: ~t.isin(*BRANDS_LIKE_CODES))
    return distinct(tokens, F.transform(tokens, lambda t: F.regexp_extract(t, "^([a-z]{1,5}[0-9]{2,5}[a-z]{0,3})", 1)))


def paren_models(name: Column) -> Column:
    return model_hints(F.array_join(found(name, r"\(([^()]*)\)"), " "))


def family_hits(a: Column, b: Column) -> Column:
    """The tokens that both have, and the shorter ones (of eight characters and more) that one of the other begins with."""
    begins = lambda x, y: F.filter(x, lambda s: (F.length(s) >= 8) & F.exists(y, lambda t: (t != s) & t.startswith(s)))
    return distinct(F.array_intersect(a, b), begins(a, b), begins(b, a))


def mount_model(name: Column, maker: Column) -> Column:
    """What follows the brand in the name of a mount, without colours and fillers, compact."""
    head = F.element_at(F.split(F.element_at(F.split(F.lower(name), "http", 2), 1), r"\(", 2), 1)
    own = found(head, "([a-zа-яё0-9]+)")
    place = F.array_position(F.transform(own, compact), maker)
    after = F.slice(own, (place + 1).cast("int"), F.greatest(F.size(own), F.lit(1)))
    skip = "black white grey gray silver черный чёрный белый серый серебристый для монитора мониторов жк".split()
    return F.when(has(head, r"\bкронштейн\w*\b|\bmount\b") & (place > 0), compact(F.array_join(F.filter(after, lambda t: ~t.isin(*skip)), " "))).otherwise("")
