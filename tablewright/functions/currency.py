"""Currency codes and amounts in text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order they are tried, on lower-case text.
CURRENCY_PATTERNS = [
    (r"us\$", "USD"), (r"\bus dollars?\b", "USD"), (r"\busd\b", "USD"),
    (r"s\$", "SGD"), (r"\bsingapore dollars?\b", "SGD"), (r"\bsgd\b", "SGD"),
    (r"c\$", "CAD"), (r"\bcanadian dollars?\b", "CAD"), (r"\bcad\b", "CAD"),
    (r"a\$", "AUD"), (r"\baustralian dollars?\b", "AUD"), (r"\baud\b", "AUD"),
    (r"hk\$", "HKD"), (r"\bhong kong dollars?\b", "HKD"), (r"\bhkd\b", "HKD"),
    (r"د\.إ", "AED"), (r"\baed\b", "AED"), (r"\bdirhams?\b", "AED"),
    (r"₹", "INR"), (r"\binr\b", "INR"), (r"\brs\.?\b", "INR"), (r"\brupees?\b", "INR"),
    (r"৳", "BDT"), (r"\bbdt\b", "BDT"), (r"\btaka\b", "BDT"),
    (r"₽", "RUB"), (r"\brub(?:le|les)?\b", "RUB"), (r"\brubels?\b", "RUB"), (r"\broubles?\b", "RUB"),
    (r"€", "EUR"), (r"\beur\b", "EUR"), (r"\beuros?\b", "EUR"),
    (r"£", "GBP"), (r"\bgbp\b", "GBP"), (r"\bpounds?\b", "GBP"),
    (r"¥", "JPY"), (r"\bjpy\b", "JPY"), (r"\byen\b", "JPY"),
    (r"\bcny\b", "CNY"), (r"\byuan\b", "CNY"), (r"\brenminbi\b", "CNY"), (r"元", "CNY"),
    (r"\$", "USD"),
]

# Names and signs of each currency, lower case.
CURRENCY_NAMES = {
    "INR": ["inr", "rupee", "rupees", "indian rupee", "indian rupees", "₹", "rs", "rs."],
    "USD": ["usd", "dollar", "dollars", "us dollar", "us dollars", "$", "us$"],
    "EUR": ["eur", "euro", "euros", "€"],
    "GBP": ["gbp", "pound", "pounds", "british pound", "british pounds", "£"],
    "JPY": ["jpy", "yen", "japanese yen", "¥"],
    "AED": ["aed", "dirham", "dirhams", "د.إ"],
    "SGD": ["sgd", "singapore dollar", "singapore dollars", "s$"],
    "CAD": ["cad", "canadian dollar", "canadian dollars", "c$"],
    "RUB": ["rub", "ruble", "rubles", "rubel", "rubels", "rouble", "roubles", "₽"],
    "BDT": ["bdt", "taka", "৳"],
    "AUD": ["aud", "australian dollar", "australian dollars", "a$"],
    "CNY": ["cny", "yuan", "renminbi", "元"],
    "HKD": ["hkd", "hong kong dollar", "hong kong dollars", "hk$"],
}


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text.cast("string"), r"[\s   ]+", " "))


def currency_code(text: Column) -> Column:
    """First code whose pattern occurs in the text, or null."""
    low = F.lower(_plain(text))
    return F.coalesce(*[F.when(low.rlike("(?U)" + p), F.lit(code)) for p, code in CURRENCY_PATTERNS])


def amount(text: Column) -> Column:
    """First signed decimal after dropping thousands commas, or null."""
    found = F.regexp_extract(F.replace(_plain(text), F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0)
    return found.try_cast("double")


def standard_amount(text: Column) -> Column:
    """``USD 1250.00`` / ``₹1,250.00``; no currency: unchanged; no amount:
    the code alone."""
    code, value = currency_code(text), amount(text)
    plain = F.concat(code, F.lit(" "), F.format_string("%.2f", value))
    rupee = F.concat(F.lit("₹"), F.format_number(value, 2))
    return F.when(code.isNull(), text).when(value.isNull(), code).when(code == "INR", rupee).otherwise(plain)


def currency_from_name(name: Column) -> Column:
    """Code for a currency name: a whole name first, then one inside the text
    (codes in the fixed order, longer names first)."""
    low = F.lower(_plain(name))
    whole = [F.when(low.isin(names), F.lit(code)) for code, names in CURRENCY_NAMES.items()]
    inside = []
    for code, names in CURRENCY_NAMES.items():
        listed = "|".join(r"\Q" + n + r"\E" for n in sorted(names, key=len, reverse=True))
        inside.append(F.when(low.rlike(rf"(?U)(?<![\w])(?:{listed})(?![\w])"), F.lit(code)))
    return F.coalesce(*whole, *inside)
