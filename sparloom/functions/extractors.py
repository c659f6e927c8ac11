"""Dates, durations, money, numbers, percentages and company names in running text, as Column builders.

Each gives an array of structs with start and end (code points, end exclusive) and the
value; null text gives an empty array. `first_only` gives a struct of the first match's
values instead. English, as the rules they follow are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, spans

# Words for numbers, months, ordinals of days, units in seconds (a month has 30 days, a year 365), currencies, shares.
WRITTEN = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000, "trillion": 1_000_000_000_000,
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "quarter": 7_776_000, "year": 31_536_000, "anniversary": 31_536_000, "decade": 315_360_000}
ARTICLES = ("a", "an", "the", "this")
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "dollar": "USD", "euro": "EUR", "pound": "GBP", "yen": "JPY", "rupee": "INR", "won": "KRW"}
CODES = ("USD", "EUR", "GBP", "JPY", "INR", "KRW", "CHF", "CAD", "AUD", "CNY", "SEK", "NOK", "DKK")
SHARES = {"%": 100, "％": 100, "percent": 100, "per cent": 100, "pct": 100, "bps": 10_000, "basis points": 10_000, "‰": 1000, "‱": 10_000, "ppm": 1_000_000, "ppb": 1_000_000_000}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: Legal forms; each also in capitals and with a full stop.
FORMS = ("Inc", "Incorporated", "Corp", "Corporation", "Co", "Company", "LLC", "Ltd", "Limited", "LP", "LLP", "PLC", "GmbH", "AG", "KG", "SARL", "SAS", "SA", "SpA", "SL", "SLU", "Ltda", "Lda", "BV", "NV", "AB", "AS", "ApS", "Oy", "KK", "GK", "Holdings", "Trust", "Pty")
#: Forms written with inner marks.
MARKED_FORMS = ("S.A.R.L.", "S.p.A.", "S.L.", "S.L.U.", "S.A.", "B.V.", "N.V.", "A/S", "K.K.", "G.K.", "s.r.o.", "z.o.o.", "d.o.o.", "L.L.C.", "L.L.P.", "L.P.")

_NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
_NO_NUMBER_BEFORE, _NO_NUMBER_AFTER = r"(?<![\w.,])", r"(?![\w]|[.,]\d)"
_WRITTEN = "|".join(WRITTEN)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _quantity(c: Column, words: dict = WRITTEN) -> Column:
    """The number in figures, as text with its scale, or else the word's value."""
    digits = F.regexp_replace(F.regexp_extract(c, _NUMBER, 0), ",", "")
    word = F.regexp_extract(F.lower(c), rf"\b({'|'.join(words)})\b", 1)
    return F.when(digits != "", digits).when(word != "", _map(words)[word].cast("string"))


def _valued(text: Column, regex: str, **values) -> Column:
    """Spans of the regex with the values of each match that has them all."""
    found = F.transform(spans(text, regex), lambda s: F.struct(s["start"], s["end"], *[f(s["match"]).alias(k) for k, f in values.items()]))
    return F.filter(found, lambda s: s[next(iter(values))].isNotNull())


def _first(text: Column, regex: str, **values) -> Column:
    """Struct of the first match's values, null without a match: without the places, which cost more than the values."""
    m = F.nullif(F.regexp_extract(text, regex, 0), F.lit(""))
    return F.when(m.isNotNull(), F.struct(*[f(m).alias(k) for k, f in values.items()]))


def money(text: Column, first_only: bool = False) -> Column:
    """amount (decimal text, scale kept) and currency: a symbol on either side, a word or a code after the amount."""
    symbols = "[$€£¥₹₩]"
    words = "dollar|euro|pound|yen|rupee|won"
    regex = rf"{symbols}\s?{_NUMBER}|(?i:\b(?:{_NUMBER}|{_WRITTEN})\s+(?:{words})s?\b)|{_NO_NUMBER_BEFORE}{_NUMBER}(?:\s?{symbols}|\s+(?:{'|'.join(CODES)})\b)"

    def currency(m: Column) -> Column:
        sign, word = F.regexp_extract(m, symbols, 0), F.regexp_extract(F.lower(m), rf"({words})s?$", 1)
        return F.when(sign != "", _map(CURRENCIES)[sign]).when(word != "", _map(CURRENCIES)[word]).otherwise(F.regexp_extract(m, "[A-Z]{3}$", 0))

    return (_first if first_only else _valued)(text, regex, amount=_quantity, currency=currency)


def percentages(text: Column) -> Column:
    """value: the share as a double."""
    units = "|".join(sorted((u.replace(" ", r"\s+") + (r"\b" if u[-1].isalpha() else "") for u in SHARES), key=len, reverse=True))
    regex = rf"(?i){_NO_NUMBER_BEFORE}(?:{_NUMBER}|(?:{_WRITTEN})(?=\s))\s*(?:{units})"
    unit = lambda m: F.regexp_replace(F.regexp_extract(F.lower(m), rf"({units})$", 1), r"\s+", " ")
    return _valued(text, regex, value=lambda m: _quantity(m).cast("double") / _map(SHARES)[unit(m)])


def roman_value(c: Column) -> Column:
    digits = F.transform(F.split(c, ""), lambda x: _map(ROMAN)[x])
    signed = F.transform(digits, lambda x, i: F.when(x < F.coalesce(F.get(digits, i + 1), F.lit(0)), -x).otherwise(x))
    return F.aggregate(signed, F.lit(0), lambda a, x: a + x)


def numbers(text: Column) -> Column:
    """value (decimal text): figures with thousands by commas, Roman numerals but a bare I, and words."""
    roman = r"(?=[MDCLXV]|I[IVX])M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})(?<=[MDCLXVI])"
    regex = rf"{_NO_NUMBER_BEFORE}{_NUMBER}{_NO_NUMBER_AFTER}|\b{roman}\b|(?i:\b(?:{_WRITTEN})\b)"
    return _valued(text, regex, value=lambda m: F.when(m.rlike("^[MDCLXVI]+$"), roman_value(m).cast("string")).otherwise(_quantity(m)))


def durations(text: Column, first_only: bool = False) -> Column:
    """quantity (decimal text), unit and seconds; a, an, the and this count as 1."""
    words = WRITTEN | dict.fromkeys(ARTICLES, 1)
    regex = rf"(?i){_NO_NUMBER_BEFORE}(?:{_NUMBER}|(?:{'|'.join(words)}))\s+(?:{'|'.join(SECONDS)})s?\b"
    unit = lambda m: F.regexp_extract(F.lower(m), r"(\w+)$", 1)
    quantity = lambda m: _quantity(F.regexp_replace(m, r"\s+\w+$", ""), words)
    seconds = lambda m: quantity(m).cast("decimal(20,6)") * _map(SECONDS)[F.regexp_replace(unit(m), "s$", "")]
    return (_first if first_only else _valued)(text, regex, quantity=quantity, unit=unit, seconds=lambda m: seconds(m).cast("double"))


def _full_year(c: Column, now: int) -> Column:
    """A year of two digits in the century that brings it nearer to `now`."""
    y, century = c.cast("int"), now // 100 * 100
    near = F.when(F.abs(y + century - now) <= F.abs(y + century - 100 - now), y + century).otherwise(y + century - 100)
    return F.when(F.length(c) == 2, near).otherwise(y)


def dates(text: Column, now: int = 2026, first: int = 1900, last: int = 2050, first_only: bool = False) -> Column:
    """value: the date; month/day/year (day first where it can't be a month), ISO, and English forms with a month's name.

    A year of two digits counts only above 31. Dates that don't exist or lie outside
    the years from `first` to `last` are left out.
    """
    month = "|".join(f"{m[:3]}(?:{m[3:]})?\\.?" if m != "may" else "may" for m in MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?")
    day, year, word = r"\d{1,2}(?:st|nd|rd|th)?", r"(?:\d{4}|3[2-9]|[4-9]\d)", "|".join(ORDINALS)
    regex = rf"(?i)(?<![\w/.-])(?:\d{{1,2}}([/.-])\d{{1,2}}\1{year}|\d{{4}}([/.-])\d{{1,2}}\2\d{{1,2}}|{day}(?:\s+day\s+of)?\s+(?:{month}),?\s+{year}|(?:{month})\s+{day},?\s+{year}|(?:{word})\s+day\s+of\s+(?:{month}),?\s+{year})(?![\w/-])"
    nth = _map({o: i + 1 for i, o in enumerate(ORDINALS)})
    named = _map({m[:3]: i + 1 for i, m in enumerate(MONTHS)})

    def made(y: Column, mo: Column, d: Column) -> Column:
        return let(_full_year(y, now), lambda full: F.when(full.between(first, last), F.try_to_date(F.format_string("%04d-%02d-%02d", full, mo, d), "yyyy-MM-dd")))

    def by_name(low: Column, parts: Column) -> Column:
        ordinal = F.regexp_extract(low, rf"^({word})\b", 1)
        month_ = named[F.regexp_extract(low, rf"({'|'.join(x[:3] for x in MONTHS)})", 1)]
        return made(F.element_at(parts, -1), month_, F.when(low.rlike(r"^\D*\d+\D*$"), nth[ordinal]).otherwise(parts[0].cast("int")))

    def by_figures(parts: Column) -> Column:
        a, b, c = parts[0], parts[1], parts[2]
        plain = F.when(a.cast("int") > 12, made(c, b.cast("int"), a.cast("int"))).otherwise(made(c, a.cast("int"), b.cast("int")))
        return F.when(F.length(a) == 4, made(a, b.cast("int"), c.cast("int"))).otherwise(plain)

    def value(m: Column) -> Column:
        return let(F.lower(m), lambda low: let(F.regexp_extract_all(low, F.lit(r"\d+"), 0), lambda parts: F.when(low.rlike("[a-z]{3}"), by_name(low, parts)).otherwise(by_figures(parts))))

    return (_first if first_only else _valued)(text, regex, value=value)


def entities(text: Column) -> Column:
    """name: capitalised words and the legal form that ends them."""
    forms = {v for f in FORMS for v in (f, f.upper())}
    ends = "|".join([f.replace(".", r"\.") for f in MARKED_FORMS] + [rf"{f}\b\.?" for f in sorted(forms, key=lambda f: (-len(f), f))])
    regex = rf"(?<![\w.])(?:[A-Z][\w&'’#-]*\.?,?\s+){{1,8}}?(?:{ends})(?![\w])"
    return _valued(text, regex, name=lambda m: m)


#: Extractors by the name of their family.
EXTRACTORS = {"date": dates, "duration": durations, "money": money, "number": numbers, "percent": percentages, "entity": entities}
