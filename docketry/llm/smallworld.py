"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt to shards by a hash of their id.  A shard's vectors stand in
order of descending level (level by a hash of the id, a sixteenth of each level
goes on to the next), so the layer of a level is the graph over the first so
many of them and its neighbours are one flat integer array.  Layers are built
from the top: a batch of vectors is searched for in the layer as it stands,
through the finished layers above it, compared with itself too, and linked to
neighbours chosen for spread (a candidate that is nearer to a chosen neighbour
than to the vector comes last); lists that get too long are chosen anew in the
same way.  The graphs are written as one row a vector.  Each query is sought in
every shard, in blocks of queries; what a graph finds is scored exactly on the
original vectors, and the best of all shards are merged.

Equal vectors are one entry of the graph: each keeps its least ids as members,
six of them, which is one more than are asked for, since a query isn't its own
neighbour.  So a vector of which a third of all rows are copies is one entry.

Shards: the root of the number of different vectors over ``SHARD_ROOT``, so a
shard of a billion holds half a million, some 300 MB at 64 components, and a
query's shards grow with the root of the table.  It is one rule at every size.

Cases: rows whose vector is null, empty, zero or holds null or non-finite
components take no part, as queries or candidates; nor do null ids.  A vector
is compared with those of its own length only.  Rows that repeat an id and its
vector count once; an id with several vectors is sought by each and found by
the likest, and is never its own neighbour.  Ties go to the smaller id.  Fewer
than k candidates: all of them.  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix
from .equalaverage import usable
from .tables import stored, with_groups

NEAREST, EVERY = 5, 50
SHARD_ROOT = 16
#: Neighbours a vector in the lowest layer and in those above; a layer keeps one of LEVEL_STEP for the next.
WIDE, NARROW, LEVEL_STEP = 32, 16, 16
#: Candidates kept while linking and while searching, and those that are opened at once.
BREADTH_BUILD, BREADTH_SEARCH, OPENED = 64, 192, 4
BATCH, MARKS = 512, 1 << 26
QUERY_BLOCK = 100_000


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first, ties to the smaller id."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def beam(x: np.ndarray, links: np.ndarray, wanted: np.ndarray, entry: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """(likeness, place) of the ``breadth`` nearest that a walk over links finds from the entries (rows, some) of each wanted vector; -1 where none.

    All rows walk at once: each opens its best places that aren't open yet.
    """
    rows = len(wanted)
    seen = np.zeros((rows, len(links)), bool)
    place = np.full((rows, breadth), -1, np.int64)
    score = np.full((rows, breadth), -np.inf, np.float32)
    open_ = np.ones((rows, breadth), bool)
    first = min(entry.shape[1], breadth)
    place[:, :first] = entry[:, :first]
    known = place[:, :first] >= 0
    at = np.nonzero(known)
    seen[at[0], place[:, :first][at]] = True
    score[:, :first][at] = np.einsum("fd,fd->f", x[place[:, :first][at]], wanted[at[0]])
    open_[:, :first] = ~known
    order = np.argsort(-score, axis=1, kind="stable")
    place, score, open_ = (np.take_along_axis(a, order, 1) for a in (place, score, open_))
    active = np.arange(rows)
    while len(active):
        closed = ~open_[active]
        rank = np.cumsum(closed, axis=1)
        chosen = closed & (rank <= OPENED)
        r, c = np.nonzero(chosen)
        if not len(r):
            break
        open_[active[r], c] = True
        near = links[place[active[r], c]]
        owner = np.repeat(active[r], near.shape[1])
        near = near.ravel()
        fresh = near >= 0
        owner, near = owner[fresh], near[fresh]
        new = ~seen[owner, near]
        owner, near = owner[new], near[new]
        key = np.unique(owner * len(links) + near)
        owner, near = key // len(links), key % len(links)
        seen[owner, near] = True
        if len(owner):
            like = np.einsum("fd,fd->f", x[near], wanted[owner])
            good = like > score[owner, -1]
            owner, near, like = owner[good], near[good], like[good]
        if len(owner):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            count = np.diff(np.append(starts, len(owner)))
            own = owner[starts]
            column = np.arange(len(owner)) - np.repeat(starts, count)
            slot = np.repeat(np.arange(len(own)), count)
            more_score = np.full((len(own), count.max()), -np.inf, np.float32)
            more_place = np.full((len(own), count.max()), -1, np.int64)
            more_score[slot, column], more_place[slot, column] = like, near
            all_score = np.concatenate([score[own], more_score], axis=1)
            all_place = np.concatenate([place[own], more_place], axis=1)
            all_open = np.concatenate([open_[own], more_place < 0], axis=1)
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :breadth]
            score[own], place[own], open_[own] = (np.take_along_axis(a, order, 1) for a in (all_score, all_place, all_open))
        active = active[~open_[active].all(axis=1)]
    return score, place


def spread(x: np.ndarray, own: np.ndarray, score: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """``width`` neighbours of each own vector among candidates, which stand best first: those not nearer to a chosen one come first, then the rest."""
    near = x[np.maximum(place, 0)]
    between = np.einsum("acd,aed->ace", near, near, optimize=True)
    there = place >= 0
    chosen = np.zeros(place.shape, bool)
    for j in range(place.shape[1]):
        blocked = (chosen[:, :j] & (between[:, :j, j] >= score[:, j : j + 1])).any(axis=1) if j else np.zeros(len(place), bool)
        chosen[:, j] = there[:, j] & ~blocked & (chosen[:, :j].sum(axis=1) < width)
    order = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :width]
    found = np.take_along_axis(place, order, 1)
    return np.pad(found, ((0, 0), (0, max(0, width - found.shape[1]))), constant_values=-1)


def linked(x: np.ndarray, uppers: list[np.ndarray], size: int, width: int) -> np.ndarray:
    """The neighbours (size, width) of the layer over the first ``size`` vectors, below the finished layers ``uppers``, topmost first."""
    links = np.full((size, width), -1, np.int32)
    done = 0
    while done < size:
        rows = np.arange(done, min(size, done + max(1, min(BATCH, MARKS // size, max(done, 64)))))
        own = x[rows]
        inside = own @ own.T
        np.fill_diagonal(inside, -np.inf)
        like, place = inside, np.broadcast_to(rows, inside.shape).copy()
        place[~np.isfinite(inside)] = -1
        if done:
            score, found = beam(x, links[:done], own, descend(x, uppers, own, done), min(BREADTH_BUILD, done))
            like, place = np.concatenate([score, like], axis=1), np.concatenate([found, place], axis=1)
        order = np.argsort(-like, axis=1, kind="stable")[:, :BREADTH_BUILD]
        like, place = np.take_along_axis(like, order, 1), np.take_along_axis(place, order, 1)
        links[rows] = spread(x, own, like, place, width)
        # the other ends of the new links
        source, column = np.nonzero(links[rows] >= 0)
        target, source = links[rows][source, column].astype(np.int64), rows[source]
        known = (links[target] == source[:, None]).any(axis=1)
        target, source = target[~known], source[~known]
        like = np.einsum("fd,fd->f", x[target], x[source])
        order = np.lexsort((source, -like, target))
        target, source = target[order], source[order]
        starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(target)))
        rank = np.arange(len(target)) - np.repeat(starts, count)
        slot = np.repeat(np.arange(len(starts)), count)
        near = rank < width
        more = np.full((len(starts), width), -1, np.int64)
        more[slot[near], rank[near]] = source[near]
        for i in range(0, len(starts), BATCH):
            ends = target[starts[i : i + BATCH]]
            both = np.concatenate([links[ends].astype(np.int64), more[i : i + BATCH]], axis=1)
            score = np.where(both >= 0, np.einsum("acd,ad->ac", x[np.maximum(both, 0)], x[ends]), -np.inf)
            order = np.argsort(-score, axis=1, kind="stable")
            links[ends] = spread(x, x[ends], np.take_along_axis(score, order, 1), np.take_along_axis(both, order, 1), width)
        done = int(rows[-1]) + 1
    return links


def descend(x: np.ndarray, uppers: list[np.ndarray], wanted: np.ndarray, below: int) -> np.ndarray:
    """Entry places of each wanted vector in a layer whose first ``below`` vectors are linked."""
    entry = np.zeros((len(wanted), 1), np.int64)
    for links in uppers:
        _, found = beam(x, links, wanted, entry, min(4, len(links)))
        entry = found
    return np.where(entry < below, entry, 0)


def normalised(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # large components' squares stay finite
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def levels(ids: np.ndarray) -> np.ndarray:
    """The level of each id: how often the uniform value of its hash falls below a power of 1 / LEVEL_STEP."""
    even = (mix(ids.astype(np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(11)).astype(np.float64) + 0.5
    return np.floor(-np.log(even / (1 << 53)) / math.log(LEVEL_STEP)).astype(np.int64)


class Graph:
    """The layers of one shard, over vectors in order of descending level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray]):
        self.ids, self.vectors, self.layers = ids, vectors, layers
        self.x = normalised(vectors)

    @staticmethod
    def built(ids: np.ndarray, vectors: np.ndarray) -> Graph:
        level = levels(ids)
        order = np.lexsort((ids, -level))
        made = Graph(ids[order], vectors[order], [])
        for k in range(int(level.max()), -1, -1):
            made.layers.append(linked(made.x, made.layers, int((level >= k).sum()), NARROW if k else WIDE))
        return made

    def nearest(self, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, id) of the k best of each original wanted vector, best first; id -1 and minus infinity where there are fewer."""
        x, most = normalised(wanted), max(1, min(BATCH, MARKS // len(self.ids)))
        scores, found = [], []
        for i in range(0, len(wanted), most):
            own = x[i : i + most]
            _, place = beam(self.x, self.layers[-1], own, descend(self.x, self.layers[:-1], own, len(self.ids)), min(BREADTH_SEARCH, len(self.ids)))
            place = place[:, : 4 * k]
            exact = np.where(place >= 0, cosine(wanted[i : i + most], self.vectors, place), -np.inf)
            best = best_rows(exact, np.where(place >= 0, self.ids[place], np.iinfo(np.int64).max), k)
            scores.append(best[0])
            found.append(best[1])
        return np.concatenate(scores), np.concatenate(found)


def cosine(wanted: np.ndarray, vectors: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The cosine in double precision of each wanted vector with the vectors at its places; equal vectors give equal values."""
    near, own = vectors[place].astype(np.float64), wanted.astype(np.float64)[:, None, :]
    near_size, own_size = np.abs(near).max(axis=2, keepdims=True), np.abs(own).max(axis=2, keepdims=True)
    # powers of two change no digit and keep squares finite
    near, own = np.ldexp(near, -np.frexp(near_size)[1]), np.ldexp(own, -np.frexp(own_size)[1])
    return (near * own).sum(axis=2) / (np.sqrt((near * near).sum(axis=2)) * np.sqrt((own * own).sum(axis=2)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def index(vectors: DataFrame) -> DataFrame:
    """(length, shard, place, id, vector, low, high) of vectors(length, shard, id, vector): a row a vector with its flat neighbours in the lowest layer and in those above."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        made = Graph.built(rows.column("id").to_numpy(), _matrix(rows.column("vector")))
        n = len(made.ids)
        high = [np.zeros(0, np.int32)] * n
        for links in made.layers[-2::-1]:
            for i in range(len(links)):
                high[i] = np.concatenate([high[i], links[i]])
        ends = np.concatenate(([0], np.cumsum([len(h) for h in high]))).astype(np.int32)
        return pa.table({
            "length": rows.column("length"), "shard": rows.column("shard"), "place": np.arange(n, dtype=np.int32), "id": made.ids, "vector": _lists(made.vectors, made.vectors.shape[1]),
            "low": _lists(made.layers[-1], WIDE), "high": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(high))),
        })

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.groupBy("length", "shard").applyInArrow(build, f"length int, shard int, place int, id long, vector {kind}, low array<int>, high array<int>")


def _graph(rows: pa.Table) -> Graph:
    rows = rows.sort_by("place")
    high, layers, k = rows.column("high").combine_chunks(), [], 1
    size, flat = np.diff(high.offsets.to_numpy()) // NARROW, high.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(size))) * NARROW
    while (n := int((size >= k).sum())) > 0:
        layers.insert(0, flat[starts[:n, None] + (k - 1) * NARROW + np.arange(NARROW)])
        k += 1
    return Graph(rows.column("id").to_numpy(), _matrix(rows.column("vector")), [*layers, _matrix(rows.column("low"))])


def searched(graphs: DataFrame, queries: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(rep, found, score): the k best of each queries(length, block, rep, vector) in each shard, in blocks of queries; counts(length, shards, blocks)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        scores, found = _graph(left).nearest(_matrix(right.column("vector")), k) if left.num_rows and right.num_rows else (np.zeros((0, k)), np.zeros((0, k), np.int64))
        there = np.isfinite(scores)
        return pa.table({"rep": np.repeat(right.column("rep").to_numpy(), there.shape[1])[there.ravel()], "found": found[there], "score": scores[there]})

    left = graphs.join(counts.select("length", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "length")
    right = queries.join(counts.select("length", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")), "length")
    by = ("length", "shard", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "rep long, found long, score double")


def first(rows: DataFrame, by: tuple[str, ...], order: tuple[Column, ...], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1; Spark keeps n a task and group before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def neighbours(rows: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id ``every`` divides, of rows(vec_id, embedding)."""
    kept = usable(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")), "vector")
    kept = stored(kept.where(F.col("id").isNotNull() & F.exists("vector", lambda v: v != 0)).withColumn("length", F.size("vector")))
    # k + 1 members of each vector are enough; the least of them stands for it
    nth = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    few = kept.withColumn("nth", nth).where(F.col("nth") <= k + 1).distinct()
    members = stored(few.withColumn("rep", F.min("id").over(Window.partitionBy("vector"))))
    alone = members.where("nth = 1").select("rep", "vector", "length")
    sizes = alone.groupBy("length").agg(F.count("*").alias("n")).collect()  # as many rows as there are lengths
    spark = rows.sparkSession
    dealt = [(r["length"], max(1, math.ceil(math.sqrt(r["n"]) / SHARD_ROOT)), max(1, math.ceil(r["n"] / every / QUERY_BLOCK))) for r in sizes]
    counts = F.broadcast(spark.createDataFrame(dealt, "length int, shards int, blocks int"))
    sharded = alone.join(counts, "length").select("length", F.pmod(F.xxhash64("rep"), "shards").cast("int").alias("shard"), F.col("rep").alias("id"), "vector")
    graphs = stored(index(sharded))
    # queries: all rows of the set; equal vectors are sought once
    wanted = kept.where(F.col("id") % every == 0).select("id", "vector")
    copies = wanted.groupBy("vector").agg(F.count("*").alias("n")).join(alone.select("vector", "rep"), "vector")
    asked = stored(with_groups(wanted, copies, "vector").select("id", "rep"))
    distinct = asked.select("rep").distinct()
    queries = alone.join(distinct, "rep", "left_semi").join(counts, "length").select("length", F.pmod(F.xxhash64("rep", F.lit(1)), "blocks").cast("int").alias("block"), "rep", "vector")
    found = first(searched(graphs, queries, counts, k + 1), ("rep",), (F.desc("score"), F.col("found")), k + 1)
    near = found.join(members.select(F.col("rep").alias("found"), F.col("id").alias("vec_id")), "found").select("rep", "vec_id", "score")
    lists = near.groupBy("rep").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))  # (k + 1)^2 at most
    copies = asked.groupBy("rep").agg(F.count("*").alias("n")).join(lists, "rep")
    paired = with_groups(asked, copies, "rep").select(F.col("id").alias("query_id"), F.explode("near").alias("x")).select("query_id", "x.*")
    others = paired.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = first(others, ("query_id",), (F.desc("score"), F.col("vec_id")), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
