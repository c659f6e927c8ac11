"""Evaluation metrics as Column builders: (prediction, gold) -> double. Null on either side is 0, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let


def _score(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def exact_match(p: Column, g: Column) -> Column:
    return _score(p == g)


def case_insensitive_match(p: Column, g: Column) -> Column:
    return _score(F.lower(p) == F.lower(g))


def normalize(c: Column) -> Column:
    """Lower-cased, without outer white space, then outer quotes, then closing punctuation; white space collapsed."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"^[\"'`]+|[\"'`]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)[.,;:!?\s]+$", ""), r"(?U)\s+", " ")


def normalized_match(p: Column, g: Column) -> Column:
    return _score(normalize(p) == normalize(g))


def regex_match(p: Column, pattern: str) -> Column:
    return _score(p.rlike(rf"\A(?:{pattern})\z"))


def contains(p: Column, g: Column, case_sensitive: bool = False) -> Column:
    return _score(F.contains(p, g) if case_sensitive else F.contains(F.lower(p), F.lower(g)))


#: Keys under which an answer object holds its answer, the first that it has.
ANSWER_KEYS = ("answer", "output", "value", "text")
NUMBER_KEYS = ("answer", "value", "score", "result")


def first_key(c: Column, keys: tuple[str, ...] = ANSWER_KEYS) -> Column:
    """Of a JSON object the value of the first key that it has (null if that is null), as text; other texts as they are."""
    held = F.json_object_keys(c)
    out = F.when(held.isNull(), c)
    for k in keys:
        out = out.when(F.array_contains(held, k), F.get_json_object(c, f"$.{k}"))
    return out.otherwise(c)


def first_field(c: Column, fields: list[str], keys: tuple[str, ...] = ANSWER_KEYS) -> Column:
    """Of a struct with the given fields the first of the keys that is one of them; the struct itself if none is."""
    return next((c[k] for k in keys if k in fields), c)


def to_number(c: Column) -> Column:
    """A number from text, a truth value or a JSON object that has one; null otherwise."""
    text = F.lower(F.trim(first_key(c.cast("string"), NUMBER_KEYS)))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.regexp_replace(text, r"(?<=\d)_(?=\d)", "").try_cast("double"))


def refs(c: Column) -> Column:
    """References as a set of texts: of a JSON array its items, any other text is one reference, null none."""
    return F.array_distinct(F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(c, "array<string>"), F.array(c))))


def numeric_close(p: Column, g: Column, tolerance: float = 1e-6) -> Column:
    return _score(F.abs(to_number(p) - to_number(g)) <= tolerance)


def numeric_ratio(p: Column, g: Column) -> Column:
    """1 less the error relative to the gold value (1 at least), never below 0."""
    x, y = to_number(p), to_number(g)
    return F.coalesce(1 - F.least(F.abs(x - y) / F.greatest(F.abs(y), F.lit(1.0)), F.lit(1.0)), F.lit(0.0))


def json_field_match(p: Column, g: Column, field: str) -> Column:
    """Both JSON objects have the field and its values are equal, null included."""
    both = F.array_contains(F.json_object_keys(p), field) & F.array_contains(F.json_object_keys(g), field)
    return _score(both & F.get_json_object(p, f"$.{field}").eqNullSafe(F.get_json_object(g, f"$.{field}")))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def set_precision(p: Column, g: Column) -> Column:
    return ratio(F.size(F.array_intersect(p, g)), F.size(F.array_distinct(p)))


def set_recall(p: Column, g: Column) -> Column:
    return ratio(F.size(F.array_intersect(p, g)), F.size(F.array_distinct(g)))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def weighted_composite(parts: dict[str, float]) -> Column:
    """Weighted mean of columns; weights are normalised."""
    total = sum(parts.values())
    out = F.lit(0.0)
    for name, w in parts.items():
        out = out + F.col(name) * (w / total)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def semantic_similarity(a: Column, b: Column) -> Column:
    return F.least(F.greatest(cosine(a, b), F.lit(0.0)), F.lit(1.0))


def semantic_match(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """1 where two embeddings' similarity within 0 and 1 is `threshold` or more, else 0; 0 where one is missing."""
    return F.when(F.coalesce(semantic_similarity(a, b), F.lit(0.0)) >= threshold, 1.0).otherwise(0.0)


def answer_relevancy(answer: Column, question: Column) -> Column:
    """Similarity of two embeddings within 0 and 1; 0 where one is missing."""
    return F.coalesce(semantic_similarity(answer, question), F.lit(0.0))


def rouge(p: Column, g: Column, n: int = 1) -> Column:
    """struct(precision, recall, f1) of word n-grams that two texts have in common, each as often as in both; words are runs of a-z and 0-9, not stemmed."""

    def grams(c: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)
        joined = lambda w: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, n), " "))
        return let(words, joined)

    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    common = lambda a, b: F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))

    def result(a: Column, b: Column) -> Column:
        return let(common(a, b), lambda k: let(F.struct(ratio(k, F.size(a)).alias("p"), ratio(k, F.size(b)).alias("r")), lambda s: F.struct(s["p"].alias("precision"), s["r"].alias("recall"), f1(s["p"], s["r"]).alias("f1"))))

    return let(grams(p), lambda a: let(grams(g), lambda b: result(a, b)))


def evaluate(rows: DataFrame, score: Column, by: list[str], error: Column | None = None, return_on_error: float = 0.0) -> DataFrame:
    """(by, n_total, n_correct, n_errors, accuracy, mean_score, error_rate): a row with an error scores return_on_error and counts in the mean."""
    failed = F.lit(False) if error is None else error.isNotNull()
    marked = rows.withColumn("_failed", failed).withColumn("_score", F.when(failed, F.lit(return_on_error)).otherwise(F.coalesce(score, F.lit(0.0))))
    right = F.count_if(~F.col("_failed") & (F.col("_score") >= 1.0))
    return marked.groupBy(*by).agg(F.count("*").alias("n_total"), right.alias("n_correct"), F.count_if("_failed").alias("n_errors"), F.round(right / F.count("*"), 4).alias("accuracy"), F.round(F.avg("_score"), 4).alias("mean_score"), F.round(F.count_if("_failed") / F.count("*"), 4).alias("error_rate"))


def multiset_counts(rows: DataFrame, by: list[str], item: str, p: Column, g: Column) -> DataFrame:
    """(by, tp, fp, fn) of two multisets: rows in which the conditions p and g hold count for the prediction and the gold."""
    counts = rows.groupBy(*by, item).agg(F.count_if(p).alias("_p"), F.count_if(g).alias("_g"))
    tp = F.sum(F.least("_p", "_g"))
    return counts.groupBy(*by).agg(tp.alias("tp"), (F.sum("_p") - tp).alias("fp"), (F.sum("_g") - tp).alias("fn"))


def confusion(rows: DataFrame, gold: str, predicted: Column) -> DataFrame:
    """(gold, predicted, n)."""
    return rows.groupBy(F.col(gold).alias("gold"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def f1_scores(confusions: DataFrame) -> DataFrame:
    """(macro_f1, micro_f1) of a confusion table; a label without any row of either kind has no part."""
    none = F.lit(0).cast("long")
    kinds = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), none.alias("p"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(none).alias("tp")), F.struct(F.col("predicted").alias("label"), none.alias("g"), F.col("n").alias("p"), none.alias("tp"))))
    by = confusions.select(kinds.alias("x")).select("x.*").groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    return by.agg(F.round(F.avg(2 * F.col("tp") / (F.col("g") + F.col("p"))), 4).alias("macro_f1"), F.round(2 * F.sum("tp") / (F.sum("g") + F.sum("p")), 4).alias("micro_f1"))


def precision_lift(rows: DataFrame, by: list[str], raw: Column, expanded: Column, relevant: Column) -> DataFrame:
    """(by, lift): precision of the expanded retrieval less that of the raw one; nothing retrieved has precision 0."""
    precision = lambda got: F.count_if(got & relevant) / F.greatest(F.count_if(got), F.lit(1))
    return rows.groupBy(*by).agg(F.round(precision(expanded) - precision(raw), 4).alias("lift"))


def refusal_rate(rows: DataFrame, by: list[str], refused: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.avg(F.coalesce(refused, F.lit(False)).cast("double")), 4).alias("refusal_rate"))


def faithfulness(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer, faithfulness): the share of an answer's claims all of whose spans hold; 1 for a refusal, 0 without claims.

    spans: (answer, claim, ok); answers: (answer, refused).
    """
    claims = spans.groupBy("answer", "claim").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).groupBy("answer").agg(F.avg(F.col("ok").cast("int")).alias("_share"))
    return answers.join(claims, "answer", "left").select("answer", F.round(F.when(F.col("refused"), 1.0).otherwise(F.coalesce("_share", F.lit(0.0))), 4).alias("faithfulness"))


#: Metrics of two columns by name.
METRICS = {
    "exact_match": exact_match, "accuracy": exact_match, "case_insensitive_match": case_insensitive_match, "normalized_match": normalized_match, "contains": contains,
    "numeric_close": numeric_close, "numeric_ratio": numeric_ratio, "semantic_similarity": semantic_similarity,
}


def metric(name: str):
    """The metric of a name, or of `contains:case_sensitive`, `numeric_close:<tolerance>`, `regex:<pattern>`, `json_field:<field>`."""
    kind, _, given = name.partition(":")
    if kind == "regex":
        return lambda p, g: regex_match(p, given)
    if kind == "json_field":
        return lambda p, g: json_field_match(p, g, given)
    if kind == "numeric_close" and given:
        return lambda p, g: numeric_close(p, g, float(given))
    if name == "contains:case_sensitive":
        return lambda p, g: contains(p, g, case_sensitive=True)
    if name not in METRICS:
        raise ValueError(f"no metric {name!r}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name]
