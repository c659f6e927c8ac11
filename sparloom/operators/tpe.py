"""Search over configurations by tree-structured Parzen estimators, some at a time.

After each batch all trials are split into good ones and the rest; the next batch is
drawn from the good ones' smoothed shares and those of the largest ratio to the rest's
are tried. One job scores all configurations of a batch over all examples, as aggregates
of one pass. The trials are a table, so a search that was broken off goes on from it.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """When a search ends, checked after each batch in this order: trials, cost, target (a mean that is enough), patience (trials without a better mean)."""

    trials: int = 32
    cost: float | None = None
    target: float | None = None
    patience: int | None = None


def shares(values: list, choices: list, prior: float) -> list[float]:
    """Share of each choice among values, each with `prior` more."""
    return [(sum(v == c for v in values) + prior) / (len(values) + prior * len(choices)) for c in choices]


def propose(trials: list[tuple[dict, float]], space: dict[str, list], n: int, rng: random.Random, startup: int = 8, gamma: float = 0.25, draws: int = 24, prior: float = 1.0) -> list[dict]:
    """Up to n configurations that haven't been tried: at random before `startup` trials, then the best log ratios of draws from the good trials' shares.

    Trials are (configuration, mean); the good ones are the best gamma of them, at least
    one, the earlier on ties. Where draws give too few new ones, those not tried in the
    order of the space follow; where all are tried, none.
    """
    total = math.prod(len(c) for c in space.values())
    seen, out = {json.dumps(c, sort_keys=True) for c, _ in trials}, []

    def take(config: dict) -> None:
        name = json.dumps(config, sort_keys=True)
        if name not in seen and len(out) < n:
            seen.add(name)
            out.append(config)

    if len(trials) < startup:
        for _ in range(8 * n):
            take({k: rng.choice(c) for k, c in space.items()})
    else:
        order = sorted(range(len(trials)), key=lambda i: (-trials[i][1], i))
        good = {i for i in order[: max(1, math.ceil(gamma * len(trials)))]}
        ratio, likely = {}, {}
        for k, choices in space.items():
            likely[k] = shares([trials[i][0][k] for i in good], choices, prior)
            rest = shares([trials[i][0][k] for i in range(len(trials)) if i not in good], choices, prior)
            ratio[k] = {json.dumps(c): math.log(a / b) for c, a, b in zip(choices, likely[k], rest)}
        drawn = [{k: rng.choices(c, likely[k])[0] for k, c in space.items()} for _ in range(draws * n)]
        for config in sorted(drawn, key=lambda c: -sum(ratio[k][json.dumps(v)] for k, v in c.items())):
            take(config)
    at = 0
    while len(out) < n and at < total:
        rest, config = at, {}
        for k, choices in space.items():
            rest, i = divmod(rest, len(choices))
            config[k] = choices[i]
        take(config)
        at += 1
    return out


def evaluate(examples: DataFrame, configs: list[dict], score: Callable[[dict], Column]) -> list[tuple[int, float]]:
    """(examples, mean score) of each configuration, a null score counting 0; one pass over the examples, one aggregate a configuration."""
    row = examples.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(score(c).cast("double"), F.lit(0.0))).alias(f"c{i}") for i, c in enumerate(configs)]).first()
    return [(row["n"], row[f"c{i}"] or 0.0) for i in range(len(configs))]


SCHEMA = "trial long, batch int, config string, n long, mean double, cost double, improves boolean"


def search(examples: DataFrame, space: dict[str, list], score: Callable[[dict], Column], path: str, limits: Limits = Limits(), batch: int = 8, seed: int = 0, price: float = 0.0, **options) -> tuple[DataFrame, str]:
    """(trials, reason): trials (trial, batch, config as JSON, n, mean, cost, improves) and why the search ended: trials, cost, target, patience or exhausted.

    score makes the Column of a configuration's score from its values. price: cost of one
    example. Each batch is a folder under `path`, written once it is scored; those that are
    there already are taken as they are, so the same call goes on where it was broken off.
    The same seed gives the same trials. Trials are as many as limits.trials at most.
    """
    spark = examples.sparkSession
    done: list[tuple[dict, float]] = []
    spent, best, since, number = 0.0, -math.inf, 0, 0
    while True:
        reason = (
            "trials" if len(done) >= limits.trials else "cost" if limits.cost is not None and spent >= limits.cost else "target" if limits.target is not None and best >= limits.target
            else "patience" if limits.patience is not None and since >= limits.patience else None
        )
        folder = f"{path}/batch={number}"
        if reason is None:
            configs = propose(done, space, min(batch, limits.trials - len(done)), random.Random(f"{seed}/{number}"), **options)
            reason = None if configs else "exhausted"
        if reason is not None:
            break
        if not _there(spark, folder):
            rows = []
            for config, (n, mean) in zip(configs, evaluate(examples, configs, score)):
                better = mean > max([best, *[r[4] for r in rows]])
                rows.append((len(done) + len(rows), number, json.dumps(config, sort_keys=True), n, mean, n * price, better))
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)
        for r in spark.read.schema(SCHEMA).parquet(folder).orderBy("trial").collect():
            done.append((json.loads(r["config"]), r["mean"]))
            spent, since, best = spent + r["cost"], 0 if r["improves"] else since + 1, max(best, r["mean"])
        number += 1
    if not number:
        return spark.createDataFrame([], SCHEMA), reason
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/batch={i}" for i in range(number)]), reason


def _there(spark, folder: str) -> bool:
    """Whether a batch was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
