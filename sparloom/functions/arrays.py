"""Array columns with running values: what Spark's array functions lack, composed of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where `use` reads it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def scan(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running results of merge over an array of int not below 0, from 0 on, each one with its own element.

    In blocks of the square root of its size: n elements take n ** 1.5 steps and not n ** 2.
    """

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(v))).cast("int"))
        fold = lambda part: F.aggregate(part, F.lit(0), merge)
        div = lambda i, w: F.floor(i / w).cast("int")
        inner = lambda w, sums: F.transform(v, lambda _, i: merge(fold(F.slice(sums, 1, div(i, w))), fold(F.slice(v, div(i, w) * w + 1, i % w + 1))))
        sums = lambda w: F.transform(F.sequence(F.lit(0), div(F.size(v) - 1, w)), lambda b: fold(F.slice(v, b * w + 1, w)))
        return let(width, lambda w: let(sums(w), lambda s: inner(w, s)))

    return F.when(F.size(values) > 0, let(values, blocks)).otherwise(F.array().cast("array<int>"))


def starts(sizes: Column) -> Column:
    """Where each of consecutive pieces of the given sizes begins."""
    return let(sizes, lambda n: F.transform(scan(n, lambda a, b: a + b), lambda end, i: end - n[i]))


def spans(text: Column, regex: str) -> Column:
    """SPAN of the regex's matches, leftmost and non-overlapping: code points, end exclusive. A match isn't empty. Null text has none."""

    def placed(m: Column, gaps: Column) -> Column:
        sizes = F.transform(m, lambda x, i: F.length(gaps[i]) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(F.lit(0)))
        return let(scan(sizes, lambda a, b: a + b), lambda at: F.transform(m, lambda x, i: F.struct(at[i].alias("start"), (at[i] + F.length(x)).alias("end"), x.alias("match"))))

    def alone(m: Column) -> Column:
        """The one match of a text: what stands before it is its start."""
        return let(F.length(F.get(F.split(text, regex, 2), F.lit(0))), lambda at: F.transform(m, lambda x: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("match"))))

    many = lambda m: let(F.split(text, regex, -1), lambda gaps: placed(m, gaps))
    found = let(F.regexp_extract_all(text, F.lit(regex), 0), lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).when(F.size(m) == 1, alone(m).cast(SPAN)).otherwise(many(m).cast(SPAN)))
    return F.when(text.isNotNull(), found).otherwise(F.array()).cast(SPAN)
