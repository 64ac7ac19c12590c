"""Reading inputs, cutting lineage and connected classes, shared by the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder of spark.checkpoint.dir.

    A lost executor then costs a read of that folder.  A folder of its own is
    made only where the session names none, as in tests.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="docketry-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the shared folder, read back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        durable(df.limit(0))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Ids that may be broadcast: 8 bytes each, some tens of megabytes as a hash table.
MOST_BROADCAST_IDS = 500_000


def within(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of df whose id is in ``ids``: filtered before any exchange if the ids, counted first, are few enough to broadcast."""
    few = ids.count() <= MOST_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


#: A key of more than this many rows, and of more than a thousandth of all, is joined by broadcast: a thousand keys at most.
HOT_ROWS = 1_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with groups, which has one row a key and its number of rows as n; no task gets a hot key's rows by an exchange."""
    groups = durable(groups)
    most = max(HOT_ROWS, (groups.agg(F.sum("n")).first()[0] or 0) // 1_000)
    hot = groups.where(F.col("n") > most)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col("n") <= most), key)
    return rows.join(F.broadcast(hot), key).select(*rest.columns).unionByName(rest)


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; of a null id, that of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def small_star(edges: DataFrame) -> DataFrame:
    """edges (u, v < u): the node's own edge goes to its least neighbour, its other neighbours follow it there."""
    lower = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def classes(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (a, b): the least node it is connected with.

    Alternating large-star and small-star steps; each is one aggregate by node
    and one join, so a hub with very many neighbours is never gathered in one
    task.  The loop ends when a round changes no edge.
    """
    edges = durable(small_star(durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())))
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small_star(large))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
