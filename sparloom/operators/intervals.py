"""Which intervals hold at which instants: a join by bins whose size follows the interval's length.

An interval of length up to 2**n lies in two bins of that size at most; an instant lies
in one bin of each size that occurs. Bins meet by an equi-join and the bounds are
checked after it, so no row is compared with all rows of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def valid_pairs(claims: DataFrame, instants: DataFrame, start: str, end: str, instant: str, keys: list[str] = ()) -> DataFrame:
    """claims joined with the instants at which they hold: from `start` on, before `end`; a null end is open, a claim without a start or that ends before it begins never holds.

    keys: columns of both sides that must be equal besides. Null instants meet nothing;
    repeated rows of either side meet each for itself. Times are timestamps or dates.
    """
    renamed = instants.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c) for c in instants.columns if c not in keys])
    at = renamed.where(F.col(instant).isNotNull()).withColumn("_at", _micros(F.col(instant)))
    last = at.agg(F.max("_at")).first()[0]
    if last is None:
        last = 0  # no instants: the join below is empty
    found = claims.where(F.col(start).isNotNull()).withColumn("_from", _micros(F.col(start)))
    # an open claim holds up to the last instant
    found = found.withColumn("_to", F.when(F.col(end).isNull(), F.lit(last + 1)).otherwise(_micros(F.col(end)))).where("_from < _to")
    level = F.ceil(F.log2(F.greatest(F.col("_to") - F.col("_from"), F.lit(1)).cast("double"))).cast("int") + 1  # one more, so that rounding of the logarithm is harmless
    found = found.withColumn("_level", level)
    bins = found.withColumn("_bin", F.explode(F.sequence(F.call_function("shiftright", "_from", F.col("_level")), F.call_function("shiftright", F.col("_to") - 1, F.col("_level")))))
    levels = sorted(r["_level"] for r in found.select("_level").distinct().collect())  # 65 at most
    dealt = at.withColumn("_l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_b", F.call_function("shiftright", "_at", F.col("_l")))
    same = (F.col("_level") == F.col("_l")) & (F.col("_bin") == F.col("_b")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    out = bins.join(dealt, same)
    return out.select(*[F.col(c) for c in claims.columns], *[F.col(c) for c in instants.columns if c not in keys])
