"""One row a key that holds the rows of several child tables, gathered by a single exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(key: str, parent: DataFrame, **children: DataFrame) -> DataFrame:
    """The parent's columns and, under each child's name, the sorted array of its rows as structs.

    All tables are dealt by the key together, so five children cost one
    exchange, not five joins.  A key of the parent comes once, children of other
    keys are left out; a key without rows of a child has an empty array.  A
    struct sorts by its first columns: these give the order.
    """
    own = F.struct(*[c for c in parent.columns if c != key])
    parts = [parent.select(key, own.alias("_own"))]
    parts += [child.select(key, F.struct(*[c for c in child.columns if c != key]).alias(name)) for name, child in children.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    held = rows.groupBy(key).agg(F.first("_own", ignorenulls=True).alias("_own"), *[F.sort_array(F.collect_list(name)).alias(name) for name in children])
    return held.where(F.col("_own").isNotNull()).select(key, "_own.*", *children)


def nest_colocated(key: str, parent: DataFrame, **children: DataFrame) -> DataFrame:
    """As nest, for tables that are bucketed alike by the key: each child is gathered and joined where it lies, without an exchange."""
    rows = parent
    for name, child in children.items():
        held = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in child.columns if c != key]))).alias(name))
        rows = rows.join(held, key, "left")
    return rows.withColumns({name: F.coalesce(name, F.array().cast(rows.schema[name].dataType)) for name in children})


def each(rows: str | Column, make) -> Column:
    """make(struct) for each struct of an array column, without nulls."""
    return F.array_compact(F.transform(rows, make))


def strings(c: Column) -> Column:
    """The array, or an empty one of strings for null."""
    return F.coalesce(c, F.array().cast("array<string>"))
