"""Aggregations and reductions of the user's own: partial states in each task, then merges.

A user gives plain functions (start, add a row, merge two states, finish). A task folds
the rows it has into one state a key and passes only states on, so a key with most
of the rows costs its last task no more than one state from each other task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a task holds states of; beyond, it passes them on and begins anew.
KEYS_HELD = 50_000


@dataclass(frozen=True)
class Fold:
    """start() makes a state, add(state, row as a dict) and merge(state, state) give a state, finish(state) the result.

    merge must not depend on the order of states, or order must be kept in them.
    """

    start: Callable[[], Any]
    add: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


#: Folds by name, for programs that choose one by configuration.
FOLDS: dict[str, Fold] = {}


def register(name: str, fold: Fold) -> Fold:
    """Makes a fold known by its name; a known name is refused."""
    if name in FOLDS:
        raise ValueError(f"there is a fold {name} already")
    FOLDS[name] = fold
    return fold


def of_name(name: str) -> Fold:
    if name not in FOLDS:
        raise ValueError(f"no fold {name}; known are {', '.join(sorted(FOLDS))}")
    return FOLDS[name]


def partial_states(rows: DataFrame, keys: list[str], fold: Fold, order: list[str] = ()) -> DataFrame:
    """(keys, _state): one pickled state for each key and task, more only where a task meets over KEYS_HELD keys."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("_state", T.BinaryType())])

    def run(batches):
        held: dict[tuple, Any] = {}

        def out():
            columns = list(zip(*held)) or [() for _ in keys]
            arrays = [pa.array(c, schema_of.field(i).type) for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], [*keys, "_state"])

        schema_of = None
        for batch in batches:
            schema_of = pa.schema([batch.schema.field(k) for k in keys])
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                held[key] = fold.add(held[key] if key in held else fold.start(), row)
            if len(held) > KEYS_HELD:
                yield out()
                held.clear()
        if schema_of is not None and held:
            yield out()

    return rows.mapInArrow(run, schema)


def aggregate(rows: DataFrame, keys: list[str], fold: Fold | str, result: str, name: str = "value") -> DataFrame:
    """(keys, name): the fold of each key's rows; result is the type of finish()'s values. Null keys are a key; no rows give none.

    States are merged one after another as they come, so the merging task holds two of them.
    """
    fold = of_name(fold) if isinstance(fold, str) else fold
    states = partial_states(rows, keys, fold)
    kind = T._parse_datatype_string(result)
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(name, kind)])

    def run(batches):
        key, state = None, None
        done: list[tuple] = []

        def out(types):
            columns = list(zip(*done)) or [() for _ in range(len(keys) + 1)]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array(columns[-1], arrow)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, [*keys, name])

        from pyspark.sql.pandas.types import to_arrow_type

        arrow, types = to_arrow_type(kind), None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for row in batch.to_pylist():
                now, more = tuple(row[k] for k in keys), pickle.loads(row["_state"])
                if state is not None and now == key:
                    state = (fold.merge(state[0], more),)
                    continue
                if state is not None:
                    done.append((*key, fold.finish(state[0])))
                key, state = now, (more,)
            if len(done) > 10_000:
                yield out(types)
        if state is not None:
            done.append((*key, fold.finish(state[0])))
            yield out(types)

    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


register("mean", Fold(lambda: (0, 0.0), lambda s, r: s if r["value"] is None else (s[0] + 1, s[1] + r["value"]), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0] if s[0] else None))
register("longest", Fold(lambda: None, lambda s, r: r["value"] if r["value"] is not None and (s is None or (-len(r["value"]), r["value"]) < (-len(s), s)) else s, lambda a, b: min((x for x in (a, b) if x is not None), key=lambda x: (-len(x), x), default=None), lambda s: s))
