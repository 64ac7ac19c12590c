"""How tables are joined: those that grow with the input are never sent to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """A side of a join that has a row or more a document.

    Spark broadcasts a table by its estimated or compressed size; ten such megabytes can
    be millions of keys, and a hash table of them is more than a driver holds.  The hint
    has the join dealt and sorted by key at every size.
    """
    return df.hint("merge")
