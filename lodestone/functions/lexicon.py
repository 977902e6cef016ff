"""Lexicons of the support domain. Every rule takes its lexicon as a parameter; these are the defaults."""

from __future__ import annotations

# Routing keywords by category, in the order that breaks ties.
ROUTES = {
    "ecp_mchd": ["криптопро", "cryptopro", "эцп", "плагин", "сертификат", "рутокен", "rutoken", "токен", "драйвер", "ошибка плагина", "не подписывает", "браузер", "chromium-gost", "яндекс браузер", "кэп", "укэп", "мчд", "доверенность", "джакарта", "jacarta", "считыватель", "не удается подписать", "ошибка 0x", "ssl", "tls", "csp"],
    "quotation_session": ["котировочн", "котировочная сессия", "закупка по потребностям", "ценовое предложение", "подать оферту", "победитель котировочной", "второй участник", "переход победы", "продление сессии", "снижение цены", "шаг снижения", "отзыв оферты", "мини-аукцион", "ставка", "победитель закупки"],
    "ste_catalog": ["сте", "стандартная товарная единица", "оферта", "оферты", "каталог товаров", "ктру", "окпд", "окпд2", "характеристики сте", "модерация сте", "прайс-лист", "загрузка yml", "yml-формат", "xsd-схема", "штрихкод", "добавление сте", "карточка сте", "вариативная заявка"],
    "contract_execution": ["электронное исполнение", "электронное актирование", "упд", "универсальный передаточный документ", "еис", "калуга астрал", "рдик", "приемка", "акт приемки", "подписание контракта", "счет на оплату", "структурированный документ", "интеграционный контроль", "черновик упд", "расторжение контракта", "допсоглашение", "протокол разногласий"],
    "registration": ["регистрация", "аккредитация", "еруз", "госуслуги", "есиа", "вход в личный кабинет", "создание профиля", "как зарегистрироваться", "роли пользователя", "смена пароля", "физическое лицо поставщик", "индивидуальный предприниматель регистрация"],
    "legal": ["жалоба в фас", "фас", "рнп", "реестр недобросовестных", "нмцк", "ст 93", "ст 44", "статья 93", "статья 44", "отклонили заявку", "отклонение заявки", "нацрежим", "постановление правительства", "44-фз", "223-фз", "135-фз", "63-фз", "закон о закупках"],
    "services": ["банковская гарантия", "независимая гарантия", "спецсчет", "специальный счет", "кредит", "факторинг", "страхование", "тариф", "оплата услуг", "депозит"],
}

# Line and badge colour by category; None is the general line.
LINES = {
    "ecp_mchd": ("L2", "#0284c7"), "quotation_session": ("L3", "#eab308"), "ste_catalog": ("L4", "#f97316"), "contract_execution": ("L5", "#8b5cf6"),
    "registration": ("L6", "#14b8a6"), "legal": ("L7", "#7c3aed"), "services": ("L8", "#06b6d4"), None: ("L1", "#16a34a"),
}

# Names of the lines.
LINE_NAMES = {
    "L1": "Линия общей поддержки и навигации по Порталу Поставщиков",
    "L2": "Линия технической поддержки (ЭЦП, КриптоПро, МЧД, ПО)",
    "L3": "Линия котировочных сессий и мини-аукционов",
    "L4": "Линия Каталога товаров, СТЕ и оферт",
    "L5": "Линия электронного актирования и исполнения контрактов (УПД/ЕИС)",
    "L6": "Линия регистрации, аккредитации и управления профилем",
    "L7": "Линия правовой экспертизы (44-ФЗ / 223-ФЗ / ФАС)",
    "L8": "Линия финансовых сервисов и гарантий",
}

# Keywords of the workflow nodes, in the order that breaks ties.
NODES = {
    "fas_complaint_44fz": ["фас", "жалоба", "жалобу", "обжалование", "отклонение заявки", "необоснованно отклонили", "ст 105", "статья 105", "статья 106", "105 фз", "нарушение заказчика", "подать в фас"],
    "registration_44fz": ["регистрация", "еруз", "аккредитация", "еис", "госуслуги", "начать торги", "авторизация", "профиль"],
    "quotation_session": ["котировочная сессия", "котировочные сессии", "оферта", "снижение цены", "победитель сессии", "шаг снижения"],
    "contract_execution_upd": ["электронное актирование", "упд", "приемка", "акт приемки", "исполнение контракта", "документ о приемке"],
    "ecp_cryptopro": ["криптопро", "cryptopro", "эцп", "кэп", "сертификат", "плагин", "рутокен", "jacarta", "токен", "браузер"],
}

# The guardrail's word stems (regular expressions that match whole words).
OFFENSIVE = ["хуй|ху[яеёи]|пизд|бля[тд]|еба[тьнл]|ёб[а-я]|муда[кч]|говн|сук[аи]|ганд|шлюх|уеб", "нахуй|похуй|заеб|доеб|приеб|выеб|отъеб|разъеб"]

# What asks for an operator, agrees, continues and stops.
OPERATOR_PHRASES = ["позови человека", "нужен человек", "живой человек", "позови оператора", "нужен оператор", "соедини с оператором", "переведи на оператора", "позови специалиста", "нужен специалист", "соедини со специалистом", "переведи на специалиста", "живой сотрудник", "живой специалист", "переведи на человека", "соедини с человеком", "хочу человека", "оператор поддержки", "специалист поддержки", "поговорить с человеком", "поговорить с оператором", "свяжи с человеком", "свяжи с оператором", "переключи на человека", "переключи на оператора"]
OPERATOR_WORDS = ["оператор", "оператора", "человек", "человека", "специалист", "специалиста"]
AGREE = ["да", "давай", "хочу", "согласен", "помоги", "давайте", "готов", "конечно", "ага"]
NEXT = ["далее", "дальше", "следующий", "следующий шаг", "готово", "сделано", "ок", "продолжить", "шаг", "вперед", "следующее"]
STOP = ["стоп", "завершить", "хватит", "отмена", "выйти", "закончить"]

# Abbreviations and what they stand for.
TERMS = {
    "СТЕ": "стандартная товарная единица", "КТРУ": "каталог товаров, работ, услуг", "РДИК": "реестр документов об исполнении контракта", "ЭДО": "электронный документооборот",
    "ЕИС": "единая информационная система в сфере закупок", "ЕСИА": "единая система идентификации и аутентификации", "ЕРУЗ": "единый реестр участников закупок", "ЛК": "личный кабинет",
    "МЧД": "машиночитаемая доверенность", "ЭП": "электронная подпись", "ПЭП": "простая электронная подпись", "УПД": "универсальный передаточный документ", "КОРП": "торговая секция КОРП",
    "РП": "руководство пользователя", "МСП": "субъекты малого и среднего предпринимательства", "NTP": "Network Time Protocol", "DDoS": "распределённая атака отказа в обслуживании", "ГК РФ": "Гражданский кодекс Российской Федерации",
}

# A document category's words, for categorising texts, in the order that breaks ties.
CATEGORIES = {
    "quotation_session": ["котировочная сессия", "котировочные сессии", "закупка по потребностям", "ценовое предложение", "подача оферты", "победитель котировочной сессии", "продление сессии", "снижение цены", "шаг снижения", "отзыв оферты"],
    "ste_catalog": ["сте", "стандартная товарная единица", "оферта", "оферты", "каталог товаров", "ктру", "окпд2", "характеристики сте", "модерация сте", "прайс-лист", "загрузка yml", "yml-формат", "xsd-схема", "штрихкод"],
    "contract_execution": ["электронное исполнение", "электронное актирование", "упд", "универсальный передаточный документ", "еис", "калуга астрал", "рдик", "приемка", "акт приемки", "подписание контракта", "счет на оплату", "структурированный документ", "интеграционный контроль"],
    "ecp_mchd": ["криптопро", "cryptopro", "эцп", "электронная подпись", "сертификат", "рутокен", "rutoken", "токен", "мчд", "доверенность", "плагин", "браузер", "кэп", "укэп", "джакарта", "jacarta", "драйвер"],
    "registration": ["регистрация", "аккредитация", "еруз", "еис", "госуслуги", "есиа", "личный кабинет", "авторизация", "вход", "создание профиля", "роли пользователя"],
    "services": ["банковская гарантия", "независимая гарантия", "спецсчет", "специальный счет", "кредит", "факторинг", "страхование", "тариф", "оплата услуг", "депозит"],
    "44fz": ["44-фз", "44 фз", "44fz", "госзакупки", "государственный контракт", "нмцк", "реестр контрактов", "закупка с полки", "есклп", "нацрежим", "аукцион в электронной форме"],
    "223fz": ["223-фз", "223 фз", "223fz", "корпоративные закупки", "корп", "росатом", "интер рао", "россети", "русгидро", "ростех", "план закупки", "субъекты мсп"],
    "legislation": ["закон", "статья", "кодекс", "положение о закупках", "регламент", "фас", "жалоба"],
}

# Federal statutes whose numbers are brought to one spelling.
STATUTES = ["44", "223", "63", "135", "149"]

# Pieces of an image's address that mark decoration.
DECORATION = ["icon", "logo", "badge", "avatar", "pixel", "counter", "svg"]
