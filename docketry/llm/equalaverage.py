"""Vector code compression: product codes whose nearest entries are found by equal-average search.

A kept vector becomes integers floor(1024 x), cut into ``PARTS`` consecutive
parts.  A codebook a part starts as that part of the first ``ENTRIES`` vectors
and is moved ``ROUNDS`` times to the floored means of the parts it is nearest
to.  Assignments are exact: entries are sorted by component sum, a part looks
at them outward from its own sum, downward and upward, and stops in a direction
once the squared gap of sums over the dimension strictly exceeds its best
distance (that quotient is a lower bound of the squared distance).  A round is
one pass over the vectors; a task sends one sum an entry and position, so what
reaches the driver has the size of the codebooks.

Cases: rows whose vector is null or holds null, NaN or infinite components are
dropped.  Vectors shorter than the longest, or whose length four doesn't
divide, count as filled up with zeros; an empty vector is all zeros.  Component
integers beyond 2^30 over the number of components count as that bound, so that
no sum of squares leaves 64 bits, and a sum over a label that does is the
largest 64-bit integer.  Null vec_ids are coded too and come after all others;
rows that repeat a vec_id are coded each, and of those the initial entries take
the lesser vector first.  Fewer rows than entries: as many entries as rows.  Of
equally near entries the lower index is taken.  An empty table gives no rows.
Other columns are not read.  A long vector costs memory in proportion to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored, with_groups

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that a task compares at once.
BLOCK = 4_096
LARGEST = (1 << 63) - 1


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has finite components only."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(column).isNotNull() & ~odd)


def integers(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, v) with floor(1024 x), filled up to one width that PARTS divides; and that width."""
    kept = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    most = float((1 << 30) // width)
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-most)), F.lit(most))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding")))
    return kept.select("vec_id", "label", filled.alias("v")), width


class Codebook:
    """The entries of one part, sorted by component sum for the search."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.index = np.argsort(sums, kind="stable")
        self.entries, self.sums, self.dim = entries[self.index], sums[self.index], entries.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of x; ties to the lower index."""
        own = x.sum(axis=1)
        at = np.searchsorted(self.sums, own)
        first = np.minimum(at, len(self.sums) - 1)
        best, found = ((x - self.entries[first]) ** 2).sum(axis=1), self.index[first]
        for step in (-1, 1):
            rows, place = np.arange(len(x)), at - 1 if step < 0 else at.copy()
            while len(rows):
                inside = (place >= 0) & (place < len(self.sums))
                rows, place = rows[inside], place[inside]
                gap = own[rows] - self.sums[place]
                near = gap * gap <= best[rows] * self.dim
                rows, place = rows[near], place[near]
                distance = ((x[rows] - self.entries[place]) ** 2).sum(axis=1)
                index = self.index[place]
                better = (distance < best[rows]) | ((distance == best[rows]) & (index < found[rows]))
                best[rows[better]], found[rows[better]] = distance[better], index[better]
                place = place + step
        return found, best


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, dimension) of a list column of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), PARTS, width // PARTS)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            cut = batch.slice(i, BLOCK)
            yield cut, _parts(cut.column("v"), width)


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (PARTS, entries, dimension) after one round over vectors(v)."""
    width, entries = books.shape[0] * books.shape[2], books.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        total = np.zeros((PARTS, entries, width // PARTS + 1), np.int64)
        for _, x in _blocks(batches, width):
            for p in range(PARTS):
                found, _ = made[p].nearest(x[:, p])
                np.add.at(total[p, :, 1:], found, x[:, p])
                total[p, :, 0] += np.bincount(found, minlength=entries)
        part, entry = np.nonzero(total[:, :, 0])
        at = np.arange(total.shape[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, len(at)).astype(np.int32)), pa.array(np.repeat(entry, len(at)).astype(np.int32)), pa.array(np.tile(at, len(part)).astype(np.int32)), pa.array(total[part, entry].ravel())],
            ["part", "entry", "at", "v"],
        )

    rows = vectors.select("v").mapInArrow(sums, "part int, entry int, at int, v long").groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((PARTS, entries, width // PARTS + 1), np.int64)
    total[rows["part"], rows["entry"], rows["at"]] = rows["v"]
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)


def trained(vectors: DataFrame, width: int) -> np.ndarray:
    """The codebooks after all rounds."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    for _ in range(ROUNDS if len(first) else 0):
        books = moved(vectors, books)
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of vectors(vec_id, label, v) under the codebooks."""
    width = books.shape[0] * books.shape[2]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books] if books.shape[1] else []
        for batch, x in _blocks(batches, width):
            found = [made[p].nearest(x[:, p]) for p in range(PARTS)]
            index = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            text = [row.tobytes().hex() for row in index]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(codes, f"vec_id long, label {kind}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of rows(vec_id, embedding, label)."""
    vectors, width = integers(rows)
    vectors = stored(vectors)
    books = trained(vectors, width)
    # a label as text, so that nulls are one key
    key = F.when(F.col("label").isNull(), "none").otherwise(F.concat(F.lit("of "), F.col("label").cast("string")))
    codes = stored(coded(vectors, books).select("vec_id", "code", "error", key.alias("key")))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LARGEST).cast("decimal(30,0)")).cast("long")
    labels = codes.groupBy("key").agg(total.alias("label_error"), F.count("*").alias("n"))
    return with_groups(codes, labels, "key").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
