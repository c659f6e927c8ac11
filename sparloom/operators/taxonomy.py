"""Label hierarchies: (name, parent), parent null for roots."""

from __future__ import annotations

from pyspark.sql import DataFrame


def paths(labels: DataFrame, separator: str = "/") -> DataFrame:
    """(name, depth, path, leaf) of every label that a root reaches; labels on a cycle have none."""
    return labels.sparkSession.sql(
        f"""with recursive tree as (
          select name, 0 as depth, name as path from {{labels}} where parent is null
          union all select l.name, t.depth + 1, concat(t.path, '{separator}', l.name) from {{labels}} l join tree t on l.parent = t.name)
        select t.name, t.depth, t.path, p.parent is null as leaf from tree t left join (select distinct parent from {{labels}}) p on p.parent = t.name""",
        labels=labels,
    )
