"""Span verification and evidence helpers as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that count as their plain forms.
PLAIN = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " "}
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl"}
STRATEGIES = ("strict", "substring", "case_insensitive", "normalized_token", "fuzzy_char", "fuzzy_token")


def plain_signs(c: Column) -> Column:
    """Curly quotes, dashes, hard spaces and ligatures in their plain forms."""
    out = F.translate(c, "".join(PLAIN), "".join(PLAIN.values()))
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def quote_hash(quote: Column) -> Column:
    return F.substring(F.sha2(quote, 256), 1, 16)


def tokens(c: Column) -> Column:
    """Lower-cased words with plain signs; punctuation at word edges is dropped, apostrophes inside stay."""
    words = F.split(F.trim(F.regexp_replace(F.lower(plain_signs(c)), r"(?U)\s+", " ")), " ")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def strict(source: Column, start: Column, end: Column, quote: Column) -> Column:
    """The source from start to end (code points, end exclusive) is the quote."""
    return (start >= 0) & (end <= F.length(source)) & (F.substring(source, start + 1, end - start) == quote)


def normalized_token(source: Column, quote: Column) -> Column:
    """The quote's tokens follow one another in the source."""
    joined = lambda c: F.concat(F.lit(" "), F.concat_ws(" ", tokens(c)), F.lit(" "))
    return (F.size(tokens(quote)) > 0) & F.contains(joined(source), joined(quote))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def common_length(source: Column, quote: Column) -> Column:
    """Length of the longest stretch of the quote that occurs in the source: for each character of the quote, whether a longer one ends there."""
    longer = lambda best, i: F.when(F.contains(source, F.substring(quote, i - best, best + 1)), best + 1).otherwise(best)
    return F.when(F.length(quote) > 0, F.aggregate(F.sequence(F.lit(1), F.length(quote)), F.lit(0), longer)).otherwise(F.lit(0))


def fuzzy_char(source: Column, quote: Column) -> Column:
    """Longest common stretch of source and quote over the quote's length; 0 for null and empty texts."""
    return F.coalesce(F.when(F.length(quote) > 0, common_length(source, quote) / F.length(quote)), F.lit(0.0))


def fuzzy_char_reaches(source: Column, quote: Column, threshold: float) -> Column:
    """Whether fuzzy_char() is `threshold` or more: whether a stretch of the quote of the least length for that occurs in the source. Only stretches of that one length are looked for."""
    n = F.length(quote)
    if threshold <= 0:
        return F.lit(True)
    k = F.greatest(F.ceil(n * threshold - 1e-9).cast("int"), F.lit(1))
    some = F.exists(F.sequence(F.lit(1), n - k + 1), lambda i: F.contains(source, F.substring(quote, i, k)))
    return F.when((n == 0) | n.isNull() | source.isNull() | (k > n), F.lit(False)).otherwise(some)


def _holds(strategy: str, source: Column, start: Column, end: Column, quote: Column, threshold: float) -> Column:
    return {
        "strict": lambda: strict(source, start, end, quote), "substring": lambda: F.contains(source, quote), "case_insensitive": lambda: F.contains(F.lower(source), F.lower(quote)),
        "normalized_token": lambda: normalized_token(source, quote), "fuzzy_char": lambda: fuzzy_char_reaches(source, quote, threshold), "fuzzy_token": lambda: token_jaccard(source, quote) >= threshold,
    }[strategy]()


def verify(source: Column, start: Column, end: Column, quote: Column, fuzzy_threshold: float = 0.8, strategies: tuple[str, ...] = STRATEGIES) -> Column:
    """The first of the strategies, in the given order, that holds, or why the last one doesn't: source_missing, similarity_below_threshold, out_of_range or quote_mismatch."""
    unknown = set(strategies) - set(STRATEGIES)
    if unknown or not strategies:
        raise ValueError(f"strategies are some of {', '.join(STRATEGIES)}")
    out = F.when(source.isNull(), "source_missing")
    for x in strategies:
        out = out.when(_holds(x, source, start, end, quote, fuzzy_threshold), x)
    if strategies[-1].startswith("fuzzy"):
        return out.otherwise("similarity_below_threshold")
    if strategies[-1] == "strict":
        out = out.when((start < 0) | (end > F.length(source)), "out_of_range")
    return out.otherwise("quote_mismatch")


def diagnostics(source: Column, start: Column, end: Column, quote: Column, fuzzy_threshold: float = 0.8) -> Column:
    """Each strategy's own result: map from strategy to whether it holds (false without a source)."""
    pairs = [(F.lit(x), F.coalesce(_holds(x, source, start, end, quote, fuzzy_threshold), F.lit(False))) for x in STRATEGIES]
    return F.create_map(*[c for pair in pairs for c in pair])


def verify_spans(spans: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """spans (source_uri, start, end, quote, ...) with verdict; the source is that of the uri in corpus (source_uri, text), missing ones are told."""
    sources = corpus.select("source_uri", F.col("text").alias("_source"))
    verdict = verify(F.col("_source"), F.col("start"), F.col("end"), F.col("quote"), **options)
    return spans.join(sources, "source_uri", "left").withColumn("verdict", verdict).drop("_source")


def verify_cited(spans: DataFrame, paragraphs: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """verify_spans() where a uri may be that of a tagged paragraph: (uri, source_uri, start, end) in paragraphs stands for its stretch of the source."""
    named = paragraphs.select(F.col("uri").alias("_uri"), F.col("source_uri").alias("_of"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    joined = spans.join(named, F.col("source_uri") == F.col("_uri"), "left")
    within = joined.withColumn("source_uri", F.coalesce("_of", "source_uri")).withColumn("start", F.coalesce(F.col("_from") + F.col("start"), F.col("start"))).withColumn("end", F.coalesce(F.col("_from") + F.col("end"), F.col("end")))
    checked = verify_spans(within.drop("_uri", "_of"), corpus, **options)
    inside = F.col("_from").isNull() | ((F.col("start") >= F.col("_from")) & (F.col("end") <= F.col("_to")))
    return checked.withColumn("verdict", F.when((F.col("verdict") == "strict") & ~inside, "out_of_range").otherwise(F.col("verdict"))).drop("_from", "_to")


def stamp_source(spans: Column, uri: Column) -> Column:
    """Spans (array of structs with source_uri) with another source_uri."""
    return F.transform(spans, lambda s: s.withField("source_uri", uri))


def refuses(confidence: Column, spans_of_each_claim: Column, verdicts: Column | None = None, least: float = 0.7, min_spans: int = 1) -> Column:
    """Whether an answer is turned into a refusal: too little confidence, a claim with too few spans, or, where verdicts are given, one that doesn't hold."""
    out = (F.coalesce(confidence, F.lit(0.0)) < least) | F.exists(spans_of_each_claim, lambda n: n < min_spans)
    return out if verdicts is None else out | F.exists(verdicts, lambda v: ~v.isin(*STRATEGIES))
