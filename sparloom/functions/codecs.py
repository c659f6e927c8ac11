"""Decoding of model answers and canonical values as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extractors
from .arrays import let


def xml_field(c: Column, name: str) -> Column:
    """The first <name>…</name>, trimmed; null if there is none."""
    found = F.regexp_extract(c, rf"(?s)<{name}(?:\s[^>]*)?>\s*(.*?)\s*</{name}>", 1)
    return F.when(c.rlike(rf"(?s)<{name}(?:\s[^>]*)?>.*?</{name}>"), found)


def chat_field(c: Column, name: str) -> Column:
    """What follows a line [name] up to the next such line."""
    found = F.regexp_extract(c, rf"(?ms)^\[{name}\]\s*(.*?)\s*(?=^\[\w+\]|\z)", 1)
    return F.when(c.rlike(rf"(?m)^\[{name}\]"), found)


def json_text(c: Column) -> Column:
    """A fenced block's content, else the outermost braces, else null."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces)


def decode_json(c: Column, schema: str) -> Column:
    return F.from_json(json_text(c), schema)


def coerce_list(c: Column) -> Column:
    """Items by line, else by semicolon, else by comma; bullets and quotes stripped, empty ones dropped."""
    by = F.when(F.contains(c, F.lit("\n")), F.split(c, "\n")).when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.filter(F.transform(by, lambda x: F.regexp_replace(F.trim(x), r"^[-*]\s+|^[\"']|[\"']$", "")), lambda x: x != "")


def close_truncated_json(c: Column) -> Column:
    """JSON cut off somewhere, with its open string, arrays and objects closed; null if that doesn't parse.

    Strings are taken out first, so that the brackets left are the structure; pairs
    that close are cancelled until only open ones remain.
    """
    whole = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', "")
    inside = F.contains(whole, F.lit('"'))
    brackets = F.regexp_replace(F.regexp_replace(whole, r'(?s)".*', ""), r"[^\[\]{}]", "")
    pairs = lambda b: F.replace(F.replace(b, F.lit("[]"), F.lit("")), F.lit("{}"), F.lit(""))
    still = F.aggregate(F.sequence(F.lit(0), F.length(brackets)), brackets, lambda b, _: pairs(b))
    ends = F.translate(F.reverse(F.regexp_replace(still, r"[\]}]", "")), "[{", "]}")
    out = F.concat(F.when(inside, F.concat(c, F.lit('"'))).otherwise(F.regexp_replace(c, r"[,:\s]+$", "")), ends)
    return F.when(F.try_parse_json(out).isNotNull(), out)


def _walk(c: Column, inline: bool) -> Column:
    """struct(text, changed, suffix) of one pass over the lexed pieces of JSON: the text with inline quotes escaped (if `inline`), whether any was, and what closes what is open at the end.

    A quote opens a string; within one it closes it, or, with `inline`, only before
    `,`, `}`, `]`, `:` or the end. Pieces are escapes, a quote with the blanks after it,
    single brackets, and stretches of all else.
    """
    pieces = F.regexp_extract_all(c, F.lit(r'(?s)\\.|"[ \t\r\n]*|[\[\]{}]|[^"\\\[\]{}]+|\\$'), 0)
    begin = F.struct(F.lit("").alias("text"), F.lit(False).alias("inside"), F.lit(False).alias("changed"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        quote, closer = F.startswith(p["piece"], F.lit('"')), F.translate(p["piece"], "{[", "}]")
        ends = quote & s["inside"] & (p["next"].rlike(r"^[,}\]:]") | p["next"].isNull() if inline else F.lit(True))
        escaped = quote & s["inside"] & ~ends
        opens = ~s["inside"] & p["piece"].isin("{", "[")
        closes = ~s["inside"] & p["piece"].isin("}", "]") & (F.substring(s["open"], 1, 1) == p["piece"])
        return F.struct(
            F.concat(s["text"], F.when(escaped, F.lit("\\")).otherwise(F.lit("")), p["piece"]).alias("text"), F.when(quote, ~s["inside"] | escaped).otherwise(s["inside"]).alias("inside"), (s["changed"] | escaped).alias("changed"),
            F.when(opens, F.concat(closer, s["open"])).when(closes, F.substring(s["open"], F.lit(2), F.length(s["open"]))).otherwise(s["open"]).alias("open"),
        )

    ahead = let(pieces, lambda a: F.transform(a, lambda x, i: F.struct(x.alias("piece"), F.get(a, i + 1).alias("next"))))
    return F.aggregate(ahead, begin, step, lambda s: F.struct(s["text"], s["changed"], F.concat(F.when(s["inside"], F.lit('"')).otherwise(F.lit("")), s["open"]).alias("suffix")))


def extract_json(c: Column) -> Column:
    """The JSON object in a model's answer, as text; null where none can be read.

    In this order: what a code fence holds, the whole answer, from its first `{` to its
    last `}`, the same with quotes inside strings escaped, and from the first `{` on
    with all that is open closed.
    """
    good = lambda x: F.when(F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull(), x)
    blank = r"^[ \t\r\n]+|[ \t\r\n]+$"
    fence = F.regexp_replace(F.regexp_extract(c, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1), blank, "")
    whole = F.regexp_replace(c, blank, "")
    inner, tail = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), F.nullif(F.regexp_extract(c, r"(?s)\{.*", 0), F.lit(""))
    mended = let(_walk(inner, True), lambda s: F.when(s["changed"], good(s["text"])))
    closed = let(_walk(F.regexp_replace(tail, r"[ \t\r\n]+$", ""), False), lambda s: F.when(s["suffix"] != "", good(F.concat(s["text"], s["suffix"]))))
    return F.coalesce(good(fence), good(whole), good(inner), mended, closed)


_SUFFIXES = "|".join(sorted({f.lower().replace(".", r"\.?") for f in (*extractors.FORMS, *extractors.MARKED_FORMS)}, key=len, reverse=True))


def entity_key(c: Column) -> Column:
    """Name without edge punctuation and corporate suffix words, lower-cased."""
    name = F.lower(F.regexp_replace(F.trim(c), r"^[ ,.;:]+|[ ,.;:]+$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"([ ,]+(?:{_SUFFIXES})\.?)+$", ""), r"\s+", " "))


def money_key(amount: Column, currency: Column) -> Column:
    """'<decimal>:<ISO>'; the scale is kept, a bare amount is in USD."""
    return F.concat(F.regexp_replace(amount, ",", ""), F.lit(":"), F.coalesce(F.upper(currency), F.lit("USD")))


def money_text_key(c: Column) -> Column:
    """money_key() of a text such as $1,000, 100 EUR or a bare number; null for others."""
    bare = F.regexp_extract(F.trim(c), r"^-?\d[\d,]*(?:\.\d+)?$", 0)
    found = extractors.money(c, first_only=True)
    return F.when(bare != "", money_key(bare, F.lit(None).cast("string"))).otherwise(money_key(found["amount"], found["currency"]))


def number_key(c: Column) -> Column:
    """A number's text without commas, its scale kept; truth values and other texts have none."""
    plain = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_replace(plain, r"^\+", ""))


def date_key(c: Column) -> Column:
    return F.date_format(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")


def date_text_key(c: Column) -> Column:
    """ISO dates by their first ten characters, else the first date in the text."""
    return F.coalesce(date_key(c), F.date_format(extractors.dates(c, first_only=True)["value"], "yyyy-MM-dd"))


def duration_seconds(quantity: Column, unit: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in extractors.SECONDS.items() for x in pair])
    return (quantity * units[F.regexp_replace(F.lower(unit), "s$", "")]).cast("long")


def duration_text_key(c: Column) -> Column:
    """Total seconds of the first duration in the text."""
    return extractors.durations(c, first_only=True)["seconds"].cast("long").cast("string")


def decode_envelope(c: Column, payload: str) -> Column:
    """Two steps: the envelope (kind, payload) first, then the payload by its own schema."""
    outer = F.from_json(c, "kind string, payload string")
    return F.struct(outer["kind"].alias("kind"), F.from_json(outer["payload"], payload).alias("payload"))


def shorten(c: Column, threshold: int, prefix: int = 64, digits: int = 16) -> Column:
    """Texts over the threshold as a prefix, their length and a digest."""
    tail = F.concat(F.lit(" ... [TRUNCATED "), F.length(c).cast("string"), F.lit(" chars; sha256="), F.substring(F.sha2(c, 256), 1, digits), F.lit("]"))
    return F.when(F.length(c) <= threshold, c).otherwise(F.concat(F.substring(c, 1, prefix), tail))


def redact(c: Column, names: tuple[str, ...] = ("KEY", "TOKEN", "SECRET", "PASSWORD"), mask: str = "[REDACTED]") -> Column:
    """A map of settings in which values are masked whose name holds one of `names`, in any case."""
    return F.transform_values(c, lambda k, v: F.when(F.upper(k).rlike("|".join(names)), F.lit(mask)).otherwise(v))


def json_diff(before: Column, after: Column) -> Column:
    """Lines of two flat JSON objects that differ, by key: `- "k": old` then `+ "k": new`."""
    a, b = F.from_json(before, "map<string,string>"), F.from_json(after, "map<string,string>")
    line = lambda sign, k, m: F.concat(F.lit(f'{sign} "'), k, F.lit('": '), F.coalesce(m[k], F.lit("null")))
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    lines = F.transform(F.filter(keys, lambda k: ~a[k].eqNullSafe(b[k]) | (F.map_contains_key(a, k) != F.map_contains_key(b, k))), lambda k: F.concat_ws("\n", F.when(F.map_contains_key(a, k), line("-", k, a)), F.when(F.map_contains_key(b, k), line("+", k, b))))
    return F.array_join(lines, "\n")
