"""Rubric scores and routing rules compiled to Column expressions. Null cells satisfy only `falsy` and `not_in`; unequal types never match."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criterion:
    column: str
    op: str
    value: object = None
    weight: float = 1.0


def predicate(c: Criterion) -> Column:
    x, v = F.col(c.column), c.value
    literal = F.lit(v) if not isinstance(v, (list, tuple)) else None
    table = {
        "eq": lambda: x == literal, "neq": lambda: x != literal, "lt": lambda: x < literal, "lte": lambda: x <= literal, "gt": lambda: x > literal, "gte": lambda: x >= literal,
        "in": lambda: x.isin(*v), "not_in": lambda: x.isNull() | ~x.isin(*v), "contains": lambda: F.contains(x.cast("string"), literal),
        "truthy": lambda: x.isNotNull() & ~_empty(x), "falsy": lambda: x.isNull() | _empty(x),
    }
    return F.coalesce(table[c.op](), F.lit(False))


def _empty(x: Column) -> Column:
    text = x.cast("string")
    return text.isin("", "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False))


def hard_score(criteria: list[Criterion]) -> Column:
    """Matched weight over absolute weight, from [-1, 1] to [0, 1]; 0.5 without criteria or weight."""
    scale = sum(abs(c.weight) for c in criteria)
    if not scale:
        return F.lit(0.5)
    matched = reduce(lambda a, b: a + b, [F.when(predicate(c), F.lit(float(c.weight))).otherwise(F.lit(0.0)) for c in criteria])
    return (matched / scale + 1) / 2


def checked(criteria: list[Criterion], hard_weight: float, soft_weight: float, soft: int) -> list[Criterion]:
    """The criteria, if a rubric may be made of them: the channels' weights sum up to 1, and a channel without criteria (`soft`: the other's number) weighs nothing."""
    if abs(hard_weight + soft_weight - 1) > 1e-9:
        raise ValueError("the channels' weights don't sum up to 1")
    if (not criteria and hard_weight) or (not soft and soft_weight):
        raise ValueError("an empty channel has a weight")
    return criteria


def aggregate_score(hard: Column, soft: Column, hard_weight: float, soft_weight: float) -> Column:
    """Weighted channels within [0, 1]; a missing soft score is 0.5."""
    return F.least(F.greatest(hard * hard_weight + F.coalesce(soft, F.lit(0.5)) * soft_weight, F.lit(0.0)), F.lit(1.0))


def route(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The first rule that holds; without any the default, or an error if there is none."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, target in rules[1:]:
        out = out.when(condition, target)
    return out.otherwise(F.lit(default) if default is not None else F.raise_error(F.lit("no rule matches")).cast("string"))


def cascade(models: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """(model, answer): of (name, answer, accepted) cheapest first, the first accepted; else the last that answered."""
    name, answer = F.lit(None).cast("string"), F.lit(None)
    for n, a, _ in models:
        name, answer = F.when(a.isNotNull(), F.lit(n)).otherwise(name), F.coalesce(a, answer)
    for n, a, ok in reversed(models):
        hit = a.isNotNull() & F.coalesce(ok, F.lit(False))
        name, answer = F.when(hit, F.lit(n)).otherwise(name), F.when(hit, a).otherwise(answer)
    return name, answer


def size_route(text: Column, limit: int = 12_000, long: str = "chunked", requested: Column | None = None) -> Column:
    """`single` for texts of up to `limit` characters, else `long` (a summariser's is `tree`, a classifier's `chunk`); what is asked for by name, other than `auto`, is taken as it is."""
    auto = F.when(F.length(text) <= limit, "single").otherwise(long)
    return auto if requested is None else F.when(requested != "auto", requested).otherwise(auto)
