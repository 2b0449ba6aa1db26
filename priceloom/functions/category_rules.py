"""The broad category that a product name tells, by ordered rules: the first that holds decides."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.functions import text as X

NO_CATEGORY = "Без категории"

# Tools by maker and kind; the rules (category, pattern, another that must hold too, one that must not); aliases.
MAKER = r"\b(?:milwaukee|p\.?\s*i\.?\s*t\.?|teh|dewalt|makita|bosch|sturm|kolner|hanskonner|workpro|metabo)\b"
TOOL = r"\b(?:дрел\w*|шуруповерт\w*|перфоратор\w*|пробойник\w*|sds|углошлиф\w*|ушм|болгарк\w*|шлифмашин\w*|электроинструмент\w*|бит\w*)\b"
ANY_TOOL = f"{MAKER}|{TOOL}"
FOR_TOOLS = r"\b(?:патрон\w*|ключ\s+патрон\w*|насадк\w*|адаптер\w*|переходник\w*|удлинитель\s+кабел\w*)\b"
BUILDING = "Строительный, слесарный, монтажный инструмент"
SERVERS = r"\b(?:сервер\w*|supermicro|apc|ups|ibm|hp|hpe|dell|chenbro|ablecom|aic|caswell|moxa|powerman|cyberpower|gooxi|inwin|fsp|lenovo|matrox|qnap|qsan|silverstone|цмо|5bites)\b"
CELLS = r"\b(?:aa|аа|aaa|ааа|aaaa|\d?cr\s?\d+|lr\s?\d+|pr\s?\d+|zinc[\s\-]?air|hr6|hr03|ncr18650|18650|nimh|li[\s\-]?ion|литиев\w*)\b|\d+\s*(?:mah|мач)\b"
DISKS = r"\b(?:wd|western\s+digital|seagate|toshiba|ultrastar|exos|gold|ironwolf)\b"
NO_DISK = r"\bssd\b|usb|flash|флеш"
SCREEN = r"\b(ips|va|tn|oled|qhd|uhd|hdr|hdmi|vga|displayport|dp)\b|\d{3,4}\s*x\s*\d{3,4}|\b\d{2,3}\s*(?:hz|гц)\b"
COOLING = r"жидкостн|\baio\b|water[\s\-]?cool|водяного\s+охлаждения|охлажд|термопаст|термопроклад|водян|сжо|радиатор|вентилятор"
SETS = r"\b(?:a4tech|acer|genius|logitech|defender|sven|hp|msi|oklick|smartbuy|crown|клавиатур|keyboard|mouse|мышь|combo|wireless\s+desktop|desktop\s+mk|mk\d{3}|km[\s\-]?\d+|fg\d+|occ\d+)\b"
RULES = (
    ("Бумага и материалы для печати", r"^\s*бумага\b"),
    ("Аксессуары для серверов", r"^\s*аксессуары для сервер"),
    ("Видеодомофоны", r"\bвидеодомофон\w*\b|\bкоммуникатор\w*\s+dahua\b"),
    ("Крепеж", r"\b(?:анкер\w*|дюбель[\s\-]?гвозд\w*|гвозд\w*[\s\-]?анкер\w*)\b"),
    ("Блендеры", r"\bблендер\w*\b"),
    ("Варочные панели", r"\bварочн\w+\s+панел\w*\b"),
    ("Кухонные плиты", r"\b(?:кухонн\w+|настольн\w+)\s+плит\w*\b"),
    ("Зарядные устройства для инструмента", r"\bзарядн\w+\s+устройств\w+\s+для\s+инструмент\w*\b"),
    ("Чехлы для смартфонов", r"\bчехол\w*\s+для\s+смартфон\w*\b"),
    ("Средства для стирки", r"\bпарфюмированн\w+\s+гранул\w+\s+для\s+бель"),
    ("Умные часы", r"\b(?:умн\w+\s+час\w*|smart\s*watch|apple\s+watch|amazfit|garmin\s+instinct)\b|\b(?:смарт[\s\-]?браслет\w*|smart\s*band)\b"),
    ("Системный блок", r"\b(?:неттоп\w*|mini[\s\-]?pc|мини[\s\-]?пк|beelink)\b"),
    ("IP-камеры", r"\bip[\s\-]?камер\w*|\bвидеокамер\w+\s+ip\b"),
    ("Камеры CCTV", r"\bcctv[\s\-]?камер\w*|\bкамер\w+\s+cctv\b"),
    ("Видеорегистраторы", r"\b(?:ip[\s\-]?)?видеорегистратор\w*\b|\bnvr\b|\bxvr\b"),
    ("Камеры CCTV", r"\bкамер\w+\s+видеонаблюден"),
    ("Сканеры штрих-кодов", r"\bсканер\w*\s+штрих[\s\-]?код\w*\b|\bbarcode\s+scanner\b"),
    ("Сканеры", r"\bсканер\w*\b|\bscanner\b"),
    ("Беспроводные адаптеры", r"\bсетевая\s+карт\w*|\bсетевой(?:\s+usb)?[\s\-]?адаптер\w*", r"wi[\s\-]?fi|wifi|bluetooth|802\.11"),
    ("Сетевые адаптеры", r"\bсетевая\s+карт\w*|\bсетевой(?:\s+usb)?[\s\-]?адаптер\w*"),
    ("Сетевые накопители (NAS)", r"\bсетев\w+\s+накопител\w*|\bnas\b"),
    ("Wi-Fi роутеры", r"\bwi[\s\-]?fi\s+роутер\w*|\bроутер\w*|\bмаршрутизатор\w*"),
    ("Коммутаторы", r"\bкоммутатор\w*\b|\bethernet\s+switch\b"),
    ("Сеть", r"\b(?:трансивер\w*|sfp[\s\-]?модул\w*|sfp\s+module|медиаконверт[ео]р\w*|преобразователь\w+.*ethernet|moxa\s+nport)\b"),
    ("Кабели и переходники", r"\bмодул\w+\b", r"\b(?:altusen|aten|kvm|ka7\d|консол\w*)\b"),
    ("Сеть", r"\bмодул\w+\b", r"\b(?:sfp|xcvr|cisco|aruba|stack|moxa|ethernet|lan|gpio|edge[\s\-]?io)\b"),
    ("Аксессуары для серверов", r"\bконтроллер\w*\b", r"\b(?:raid|perc|megaraid|lsi|broadcom|adaptec|gooxi|dell|hpe)\b"),
    ("Сеть", r"\bконтроллер\w*\b"),
    ("Кабели и переходники", r"\b(?:poe[\s\-]?инжектор\w*|poe[\s\-]?сплиттер\w*|poe[\s\-]?удлинител\w*|hdmi\s+extender|разветвител\w+\s+hdmi)\b"),
    ("Кабели и переходники", r"\b(?:коннектор\w*\s+rj|rj[\s\-]?45|розетк\w+\s+сетев\w*|патч[\s\-]?панел\w*)\b"),
    ("Проводные телефоны", r"\b(?:ip\s*[\-]?\s*телефон\w*|телефон\w*\s+ip|телефон\w*\s+dect|dect[\s\-]?телефон\w*)\b"),
    ("Радиотелефоны DECT", r"\b(?:радиотелефон\w*|система\s+dect)\b"),
    ("Проводные телефоны", r"\b(?:voip\s*[\-]?\s*шлюз\w*|ip\s*[\-]?\s*атс)\b"),
    ("Шкафы", r"\b(?:шкаф\s+коммутационн\w*|шкаф\s+монтажн\w*|шкаф\s+серверн\w*|серверн\w+\s+шкаф\w*|стойк\w+\s+19)\b"),
    ("Аксессуары для серверов", r"\b(?:рельс\w*|салазк\w*|монтажн\w+\s+комплект\w*|комплект\w+\s+для\s+монтаж\w+\s+в\s+стойк\w*|корзин\w*|направляющ\w+|полк\w+)\b", SERVERS),
    ("Компьютеры", r"\bсерверн\w+\s+платформ\w*|\bплатформ\w+.*(?:gooxi|lga|c621|msi|cubi|pro\s+dp)|\bсервер\b"),
    ("Аккумуляторы для ИБП", r"\b(?:аккумулятор\w*|батаре\w+)\s+для\s+(?:ups|ибп)\b|^\s*12v\b.*\b(?:аккумулятор|батаре)"),
    ("Аккумуляторы для инструмента", r"\bаккумулятор\w*\s+для\s+инструмент\w*"),
    ("Внешние аккумуляторы", r"\bвнешн\w+\s+аккумулятор\w*|\bpower\s*bank\b|\bpowerbank\b"),
    ("Батарейки, аккумуляторы, зарядные", r"\b(?:батарейк\w*|аккумулятор\w*)\b", CELLS),
    ("Зарядные устройства", r"\b(?:сзу|азу|сетев\w+\s+зарядн\w+\s+устройств\w*|автомобильн\w+\s+зарядн\w+|беспроводн\w+\s+(?:зу|зарядн\w+))\b"),
    ("Стабилизаторы и сетевые фильтры", r"\b(?:блок\w*\s+распределени\w+\s+питани\w*|сетев\w+\s+фильтр\w*|\bpdu\b|удлинител\w+\s+сетев\w*|стабилизатор\w*)"),
    ("Аккумуляторы для ИБП", r"\b(?:внешн\w+\s+батарейн\w+\s+блок\w*|батарейн\w+\s+блок\w+.*online)\b"),
    ("Принтеры", r"\bблок\w*\s+для\s+сбор\w+\s+чернил"),
    ("Фотобумага", r"\bфото[\s\-]?бумаг\w*|\bхолст\w*.*\bструйн\w+\s+печати\b"),
    ("Шредеры", r"\bшредер\w*\b"),
    ("Ламинаторы", r"\bламинатор\w*\b"),
    ("Пылесосы", r"\bпылесос\w*\b"),
    ("Средства для стирки", r"\bкондиционер\w*\s+для\s+бель|\bкапсул\w+\s+для\s+стирк"),
    ("Средства для посудомоечных машин", r"\bкапсул\w+\s+для\s+посудомоечн"),
    ("Чистящие средства", r"\b(?:влажн\w+\s+)?чистящ\w+\s+салфетк\w*|\bсалфетк\w+\s+для\s+техник"),
    ("Планшеты", r"\bпланшет\w*\b|\bipad\b"),
    ("Комплекты периферии", r"\b(?:набор|комплект)\b", SETS),
    ("Камеры CCTV", r"\bкомплект\w*\s+видеонаблюдени\w*"),
    ("Офисные кресла", r"\bкресл\w+\b|\bburokrat\b|\bбюрократ\b"),
    ("Конструкторы", r"\blego\b"),
    ("Новогоднее освещение", r"\b(?:гирлянд\w*|дюралайт|светодиодн\w+\s+шнур\w*)\b"),
    ("Уличное освещение", r"\bсветодиодн\w+\s+ламп\w*|\bпрожектор\w*\b"),
    ("Системы автоматического полива, распылители", r"\b(?:дождевател\w*|пистолет[\s\-]?распылител\w*|систем\w+\s+туманообразовани\w*)\b"),
    ("Поливочные шланги", r"\bполивочн\w+\s+шланг\w*"),
    ("Проекционные экраны", r"\bпроекционн\w+\s+экран\w*|\bэкран\w*\s+для\s+проектор|\bэкран\w*\s+cactus"),
    ("Антенны беспроводной связи", r"\bантенн\w+\b"),
    ("Принтеры", r"\bтермоголовк\w+\s+для\s+принтер|\b(?:отрезчик\w*|нож\s+отрезчика)\s+для\s+принтер"),
    ("Видеодомофоны", r"\b(?:вызывн\w+\s+панел\w*|панел\w+\s+управлени\w+\s+сигнализац\w*|считывател\w*|терминал\w*\s+контрол\w+\s+доступ\w*)\b"),
    ("Камеры CCTV", r"\b(?:монтажн\w+\s+коробк\w+|пульт\w+.*камер\w+|блок\w+\s+сигнализац\w+|изолятор\w+\s+сигнал\w+|каркас\w+\s+монтажн\w+)\b", r"\b(?:dahua|hikvision|tiandy|acv|видеонаблюден)\b"),
    ("Системы контроля доступа", r"\b(?:шлагбаум\w*|стрел\w+\s+для\s+шлагбаум\w*|турникет\w*)\b"),
    ("Умный дом", r"\b(?:умн\w+\s+дверн\w+\s+замок\w*|smart\s+tuya)\b"),
    ("Сеть", r"\bмежсетев\w+\s+экран\w*|\bfirewall\b"),
    ("Кабели и переходники", r"\bпереключател\w+\b", r"\b(?:aten|kvm|hdmi|usb|ps\s*2)\b"),
    ("Картридеры", r"\bкартридер\w*|\bcard\s*reader\b"),
    ("Рюкзаки", r"\bрюкзак\w*\b|\bbackpack\b"),
    ("ИБП", r"\bисточник\w*\s+бесперебойн\w+\s+питани\w+|\bups\b"),
    ("Точки доступа Wi-Fi", r"\b(?:беспроводн\w+\s+мост\w*|wireless\s+bridge)\b"),
    ("Точильные станки", r"\b(?:заточн\w+\s+станок\w*|точильн\w+\s+станок\w*)\b"),
    ("Перфораторы и отбойные молотки", r"\b(?:отбойн\w+\s+молоток\w*|перфоратор\w*\s+и\s+отбойн)\b"),
    ("Плиткорезы и отрезные станки", r"\bплиткорез\w*\b"),
    ("Аксессуары для газонной техники, кусторезов и садовых ножниц", r"\b(?:леск\w+\s+для\s+триммер\w*|триммерн\w+\s+леск\w*)\b"),
    ("Ящики для инструментов", r"\bящик\w+\s+для\s+инструмент"),
    ("Кабельный крепеж", r"\bстяжк\w+\s+(?:нейлонов\w+|кабельн\w*)"),
    ("Оптические приводы", r"\b(?:диск\w+\s+dvd|dvd[\s\-]?[rw])\b"),
    ("Кабели и переходники", r"\b(?:hdmi|displayport|dp|vga)\b.*\b(?:переходник|адаптер|extender|разветвител)"),
    ("Компьютеры", r"\b(?:khadas|myir|firefly)\b"),
    ("Металлодетекторы", r"\bметаллодетектор\w*\b"),
    ("Аэрофритюрницы", r"\b(?:аэрофритюрниц\w*|air\s+fryer)\b"),
    ("Сушильные машины", r"\bсушильн\w+\s+машин\w*"),
    ("Аксессуары для серверов", r"\b(?:плат\w*\s+(?:расширени\w+|интерфейсн\w+)|райзер\w+|pci[\s\-]?ex)\b"),
    ("Кронштейны", r"\bстойк\w+\b", None, r"\bстойк\w+\s+для\b"),
    ("Хозяйственные инструменты", r"\bдержател\w+\b", rf"{ANY_TOOL}|\b(?:головок|workpro|maxpiler)\b"),
    ("Кронштейны", r"\bдержател\w+\b"),
    ("Кабели и переходники", r"\b(?:консоль\w*|переключател\w+)\b", r"\b(?:aten|kvm|altusen)\b"),
    ("Сеть", r"\b(?:преобразователь\w+|moxa)\b"),
    ("Проводные телефоны", r"\bтелефон\w*\b", r"\b(?:panasonic|ritmix|texel)\b"),
    ("Картриджи", r"\bepson\s+c13"),
    ("Акустика", r"\bстойк\w+\s+для\s+микрофон\w*|колонк|акустик|speaker"),
    ("Наушники", r"\bнаушник\w*|\bгарнитур\w*|\bheadset\b|\bheadphones\b"),
    ("Микрофоны", r"\bмикрофон\w*\b"),
    ("Саундбары", r"\bсаундбар\w*|\bsoundbar\b"),
    ("Информационные панели", r"\bинформационн\w+\s+панел\w*"),
    ("Проекторы", r"\bпроектор\w*\b"),
    (BUILDING, r"\bстойк\w*\s+для\b", TOOL),
    (BUILDING, FOR_TOOLS, ANY_TOOL),
    ("Шуруповерты, гайковерты, электроотвертки", r"\bдрел\w*[\s\-]?шуруповерт\w*|\bгайковерт\w*|\bшуруповерт\w*|\bэлектроотвертк\w*"),
    ("Перфораторы", r"\bперфоратор\w*\b"),
    ("Дрели", r"\bдрел\w*\b"),
    ("Шлифмашины", r"\b(?:углошлиф\w*|ушм|болгарк\w*|шлифмашин\w*|шлифовальн\w+\s+машин\w*)\b"),
    ("Граверы", r"\bгравер\w*\b"),
    ("Шлифовальные диски, насадки, листы", r"\b(?:отрезн\w+\s+диск\w*|круг\w+\s+лепестков\w*|шлифовальн\w+\s+диск\w*)\b"),
    ("Коронки", r"\bкоронк\w*\b"),
    ("Биты и насадки", r"\b(?:бит\w+|насадк\w+)\b", MAKER),
    ("Шлифовальные диски, насадки, листы", r"\b(?:диск\w*|круг\w*)\s+шлифовальн\w*|\bкруг\w*\s+лепестков\w*"),
    ("Хозяйственные инструменты", r"\bструбцин\w*|\bотвертк\w*"),
    ("Материнская плата", r"^\s*(?:mb|motherboard|мат\s+плат|материнск)"),
    ("Кабели и переходники", r"^\s*(?:кабель|cable|патч[\s\-]?корд|переходник|удлинитель)\b"),
    ("Жесткий диск", r"^\s*\d+(?:tb|тб)\b", None, NO_DISK),
    ("Жесткий диск", r"\b(?:sata|sas|7200\s*rpm|5400\s*rpm|3\s*5|2\s*5)\b", DISKS, NO_DISK),
    ("Системный блок", r"\b(компьютер|моноблок)\b|системный\s+блок|\bпэвм\s+tgpc\b|\btgpc\s+office\b|gaming\s+(?:black|white)|\bdesktop\s+pc\b|iven\s+(?:office|home|pro|ultra)"),
    ("Охлаждение", COOLING),
    ("Кронштейны", r"\bкронштейн\w*\b"),
    ("Монитор", r"\bмонитор\b|\bdisplay\b"),
    ("Монитор", r"^\s*\d{2}(?:\s\d)?\s*дюйм", SCREEN),
    ("Периферия", r"web[\s\-]?cam|web[\s\-]?кам|веб[\s\-]?кам|камера\s+logitech"),
    ("Клавиатура", r"\bклавиатур|keyboard"),
    ("Мышь", r"\bмышь\b|\bмыши\b|\bmouse\b"),
    ("Сеть", r"wi[\s\-]?fi|wifi|bluetooth"),
    ("Сверла и буры", r"\b(?:сверл\w*|бур\w*)\b"),
    ("Накопители USB", r"\b(?:micro\s*sd|microsd|sdhc|sdxc|карта\s+памяти)\b"),
    ("Корпус", r"\bкорпус\b|\bcase\b|midi[\s\-]?tower|mini[\s\-]?tower"),
    ("Блок питания", r"\bбп\b|блок питания|power supply|\bpsu\b", None, r"\bбез\s+бп\b|\bбез\s+блока\s+питания\b|\bno\s*psu\b|\bwithout\s+psu\b"),
    ("Кабели и переходники", r"\bкабель\b|\bcable\b|\bпереходник\b|\badapter\b|\bадаптер\b|\bпатч[\s\-]?корд\b"),
    ("Периферия", r"\b(dvdrw|dvd[\s\-]?rw|оптическ(?:ий|ий привод)|привод\s+dvd)\b"),
    ("Кабели и переходники", r"\bugreen\b", r"\b(?:us158|30345)\b"),
    ("USB-хабы", r"usb[\s\-]?хаб|usb[\s\-]?hub|\bhub\b|док[\s\-]?станц"),
    ("USB-хабы", r"разветвител[ья]?\s+usb", r"\b(?:uhb[\s\-]|dhub[\s\-]|dub[\s\-]\w+|hub[\s\-]?\d+|cm(?:219|806)\b|wf12\b|ou2270p\b|uh\d{3,4}c?\b)\b|[2345678]xusb|1in\s*-\s*\d+out"),
    ("Кабели и переходники", r"разветвител[ья]?\s+usb"),
    ("SSD", r"\bssd\b|\bnvme\b|\bm\.?2\b|твердотельн"),
    ("Жесткий диск", r"\bhdd\b|жестк|винчестер"),
    ("Накопители USB", r"накопител[ьи]?\s+usb|usb[\s\-]?(?:flash|drive)|\bflash\b|флеш"),
    ("Накопители USB", r"\busb\s*[23](?:\s*\d)?\b", r"\b\d+(?:gb|гб|tb|тб)\b"),
    ("Сумки и чехлы для ноутбуков", r"\bсумк|чехол для ноутбука|laptop bag|notebook bag|laptop case"),
    ("Системный блок", r"\bпэвм\b|\btgpc\b"),
    ("Аксессуары", r"чехол для планшета|\bшасси\b|подставка для ноутбука"),
    ("Оперативная память", r"\bddr[345]\b|оперативн|\bram\b|so[\s\-]?dimm|\bdimm\b"),
    ("Ноутбук", r"(?<!для )ноутбук|\blaptop\b|\bnotebook\b"),
    ("Кулер", r"\bкулер\b|cooler"),
    ("Процессор", r"(?<!для\s)процессор|\bcpu\b|\bintel core\b|\bryzen\b"),
    ("Материнская плата", r"материн|\bmotherboard\b|\bmb\b|\bb[34567]\d{2}m?\b|\bh[456]\d{2}m?\b|\bz[67]\d{2}\b|\bx[45667]\d{2}\b|\ba[3567]\d{2}\b"),
    ("Видеокарта", r"видеокарт|\bgpu\b|geforce|radeon|\brtx\b|\bgtx\b|\brx\s?\d{3,4}\b"),
    ("Корпус", r"full[\s\-]?tower"),
    ("Блок питания", r"\bбп\b|блок питания|power supply|\bpsu\b"),
    ("Монитор", r"монитор|display"),
    ("Принтер и МФУ", r"\bпринтеры?\b|\bмфу\b|\bmfp\b"),
    ("Аксессуары", r"коврик|mouse[\s\-]?pad|mousepad"),
    ("Сеть", r"точка доступа"),
    ("Кабели и переходники", r"кабель|переходник|адаптер|патч[\s\-]?корд"),
)
ALIASES = {
    "компьютер": "Системный блок", "компьютеры": "Системный блок", "моноблок": "Системный блок", "моноблоки": "Моноблоки", "принтер": "Принтеры", "принтеры": "Принтеры", "принтеримфу": "Принтеры",
    "мфу": "Принтеры", "картридж": "Картриджи", "картриджи": "Картриджи", "сумка": "Сумки и чехлы для ноутбуков", "сумки": "Сумки и чехлы для ноутбуков", "коврик": "Коврики для мыши",
    "коврики": "Коврики для мыши", "внешний": "Внешние накопители", "жидкостное": "Охлаждение", "смартфон": "Смартфоны", "смартфоны": "Смартфоны", "видеодомофон": "Видеодомофоны",
    "видеодомофоны": "Видеодомофоны", "usb2": "Накопители USB", "usb2.0": "Накопители USB", "usb3": "Накопители USB", "usb3.0": "Накопители USB", "usb3.1": "Накопители USB", "usb3.2": "Накопители USB",
}


def plain(name: Column) -> Column:
    """The name without a leading [tag], in lower case, with letters, digits, + and - only."""
    bare = F.regexp_replace(F.lower(name), r"^\s*\[[^\]]+\]\s*", "")
    inches = F.regexp_replace(bare, '^(\\s*[0-9]{2})(?:[.,]([0-9]))?\\s*["”]', "$1 $2 дюйм ")
    yo = F.regexp_replace(inches, "ё", "е")
    return X.strip(F.regexp_replace(F.regexp_replace(yo, r"[^a-zа-я0-9+\s-]", " "), r"\s+", " "))


def category(name: Column) -> Column:
    """The category of the first rule that a name fulfils, else its first word in capitals.

    The plain name is an element of an array, so that it is worked out once and not by each rule.
    """
    return F.get(F.transform(F.array(plain(name)), _decided), F.lit(0))


def _decided(text: Column) -> Column:
    has = lambda pattern: text.rlike(f"(?U){pattern}")

    def holds(pattern: str, also: str | None = None, unless: str | None = None) -> Column:
        test = has(pattern)
        test = test & has(also) if also else test
        return test & ~has(unless) if unless else test

    first = F.upper(F.regexp_extract(text, "([a-zа-я0-9+-]+)", 1))
    return F.coalesce(F.when(F.coalesce(text, F.lit("")) == "", NO_CATEGORY), *[F.when(holds(*rule), kind) for kind, *rule in RULES], F.nullif(first, F.lit("")), F.lit(NO_CATEGORY))


def canonical(label: Column, aliases: dict[str, str] | None = None) -> Column:
    """The category that a label stands for, letter case and spaces aside; others stay, blanks are null. A catalogue's own aliases come as a parameter."""
    trimmed = F.nullif(X.strip(label), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in (ALIASES if aliases is None else aliases).items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.regexp_replace(F.lower(trimmed), ",", "."), r"\s", "")), trimmed)
