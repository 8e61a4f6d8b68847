"""Joins whose left key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one row in so many is joined by broadcast: there are at most so many of those.
SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined to ``table``, which has at most one row for each of ``keys``.

    Rows with a null key find nothing.  Keys with at least a ``SHARE``-th of all
    rows are at most ``SHARE`` many, whatever the size of the input, so what
    ``table`` has for those is broadcast and their rows stay where they are; the
    other rows are dealt out by key.  ``rows`` is read several times: give a
    written table, not a long plan.
    """
    some = F.lit(True)
    for k in keys:
        some &= F.col(k).isNotNull()
    keyed = rows.where(some)
    total = keyed.count()
    hot = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * SHARE >= total).select(*keys, F.lit(True).alias("_hot"))
    marked = keyed.join(F.broadcast(hot), keys, "left")
    few = F.broadcast(table.join(F.broadcast(hot.select(*keys)), keys, "left_semi"))
    names = [*rows.columns, *[c for c in table.columns if c not in keys]]
    empty = rows.where(~some)
    for c, kind in table.dtypes:
        if c not in keys:
            empty = empty.withColumn(c, F.lit(None).cast(kind))
    return (
        marked.where("_hot").join(few, keys, "left").select(*names)
        .union(marked.where("_hot is null").join(table, keys, "left").select(*names))
        .union(empty.select(*names))
    )
