"""MinHash near-dedup by BagMinHash over the multiset of five-word shingles.

A shingle with count w is the weight interval (0, w].  The interval is covered
by the blocks (0,1], (1,2], (2,4], (4,8] ...; each (shingle, block) has a
Poisson process in time whose rate is the block's length, and each of its
points falls on a uniform place of the block, so the points at or below w form
a process of rate w that two documents share up to the smaller of their
weights.  Each point also picks one of ``REGISTERS`` registers, and a register
keeps the earliest point.  Two registers agree with the probability of the
weighted Jaccard likeness.  A process stops once its time is past the largest
register of its document, so a document costs about its number of shingles
plus REGISTERS * ln(REGISTERS) points, whatever the weights are.

Cases: null and blank texts have no shingles; they only fall into a class with
texts equal to them (null counts as empty).  A text of under five words is one
shingle.  A null doc_id is in no class.  Rows that repeat a doc_id are one
document: it is put into buckets by its text of least hash, and a likeness of
any of its texts links it.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, bags, by_slice, cuts, lists, mix, utf8
from .tables import classes, durable, with_groups

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 20, 7
REGISTERS = BANDS * ROWS
#: Nodes and elements of a block; two blocks meet in a task.
NODES, ELEMENTS = 1_024, 1_000_000
#: Elements of more sets than this are counted by a matrix product, others by pairs of sets.
OFTEN = 32
SLACK = 4.3
_STEP, _BLOCK, _PLACE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The earliest point of each register, (rows, registers); infinite where a row has no shingles."""
    best = np.full(rows * registers, np.inf)
    parts, k = [], 0
    while True:
        low, size = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        some = np.flatnonzero(weight > low)
        if not len(some):
            break
        seed = mix(shingle[some] * _STEP + np.full(1, k + 1, U) * _BLOCK)
        parts.append((row[some], seed, np.full(len(some), float(size)), np.full(len(some), float(low)), weight[some].astype(float)))
        k += 1
    if not parts:
        return best.reshape(rows, registers)
    row, seed, size, low, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, turn = np.zeros(len(row)), 0
    while len(row):
        many = int(np.clip(16_384 // len(row), 1, 64))
        bits = mix(seed[:, None] + (np.arange(turn + 1, turn + many + 1, dtype=U) * _STEP)[None, :])
        times = time[:, None] + np.cumsum(-np.log(_uniform(bits)), axis=1) / size[:, None]
        more = mix(bits ^ _PLACE)
        # high bits pick the register, low bits the place in the block
        register = ((more >> U(32)) * U(registers)) >> U(32)
        place = low[:, None] + ((more & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * size[:, None]
        slot = row[:, None] * registers + register.astype(np.int64)
        held = (place < weight[:, None]) & (times < best[slot])
        np.minimum.at(best, slot[held], times[held])
        time, turn = times[:, -1], turn + many
        on = time < best.reshape(rows, registers).max(axis=1)[row]
        if not on.all():
            row, seed, size, low, weight, time = (x[on] for x in (row, seed, size, low, weight, time))
    return best.reshape(rows, registers)


def _bag(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets)
    at, hashes = words.shingles(k)
    return bags(words.row[at], hashes)


def _signed(k: int, bands: int, rows: int):
    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        keys, weight = _bag(data, offsets, k)
        at = (keys >> U(48)).astype(np.int64)
        sign = signature(at, keys & U((1 << 48) - 1), weight, len(batch), bands * rows)
        full = np.isfinite(sign[:, 0])
        bits = sign.view(U).reshape(-1, bands, rows)
        band = np.tile(np.arange(1, bands + 1, dtype=U), (len(sign), 1))
        for j in range(rows):
            band = mix(band * _STEP + bits[:, :, j])
        flat = band[full].view(np.int64).ravel()
        short = pa.array([x.tobytes() for x in mix(sign.view(U)).astype(np.uint8)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("same"), lists(flat, np.where(full, bands, 0), pa.int64()), short], ["doc_id", "same", "bands", "sketch"]
        )

    return lambda batches: by_slice(make, batches)


def _perhaps(at_least: float, registers: int):
    """Keeps the pairs (a, b) whose sketches, a byte a register, agree as often as those of likeness at_least do but for
    SLACK standard deviations; one such pair in 100,000 is lost here, far fewer than by the bands."""
    least = registers * at_least - SLACK * (registers * at_least * (1 - at_least)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, registers) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _alike(k: int, at_least: float):
    """Keeps the pairs (a, b) whose texts have a weighted Jaccard likeness of at_least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = utf8(batch.column("text_a")), utf8(batch.column("text_b"))
            for i, j in cuts(oa + ob):
                ka, ca = _bag(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i], k)
                kb, cb = _bag(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i], k)
                at = np.searchsorted(kb, ka)
                hit = at < len(kb)
                hit[hit] = kb[at[hit]] == ka[hit]
                shared = np.bincount((ka[hit] >> U(48)).astype(np.int64), np.minimum(ca[hit], cb[at[hit]]), j - i)
                total = sum(np.bincount((x >> U(48)).astype(np.int64), c, j - i) for x, c in ((ka, ca), (kb, cb)))
                like = shared / np.maximum(total - shared, 1)
                out = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b"), pa.array(like >= at_least)], ["a", "b", "alike"])

    return run


def _elements(k: int):
    """(doc_id, bag): the multiset of shingles of each text as a set of numbers, one for each (shingle, occurrence)."""

    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        keys, weight = _bag(data, offsets, k)
        at = np.repeat((keys >> U(48)).astype(np.int64), weight)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
        made = mix(np.repeat(keys & U((1 << 48) - 1), weight) * _STEP + turn.astype(U) * _BLOCK)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(made.view(np.int64), np.bincount(at, minlength=len(batch)), pa.int64())], ["doc_id", "bag"])

    return lambda batches: by_slice(make, batches)


def shared_counts(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many elements each two of n sets have in common; flat: their elements, owner: the set of each, ascending."""
    _, key, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.zeros((n, n))
    often = np.flatnonzero(times > OFTEN)
    column = np.full(len(times), -1)
    column[often] = np.arange(len(often))
    for lo in range(0, len(often), 2048):
        of = column[key]
        some = (of >= lo) & (of < lo + 2048)
        held = np.zeros((n, min(2048, len(often) - lo)), np.float32)
        held[owner[some], of[some] - lo] = 1
        shared += held @ held.T
    rare = np.flatnonzero((times[key] > 1) & (times[key] <= OFTEN))
    rare = rare[np.argsort(key[rare], kind="stable")]
    k, o = key[rare], owner[rare]
    for step in range(1, OFTEN):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        np.add.at(shared, (o[:-step][same], o[step:][same]), 1)
        np.add.at(shared, (o[step:][same], o[:-step][same]), 1)
    return shared


def forest(bags: list[np.ndarray], roots: np.ndarray, at_least: float) -> list[tuple[int, int]]:
    """Pairs of likeness at_least that join what is alike among the sets; pairs of one root are left out."""
    n = len(bags)
    size = np.array([len(x) for x in bags])
    shared = shared_counts(np.concatenate(bags), np.repeat(np.arange(n), size), n)
    near = shared / np.maximum(size[:, None] + size[None, :] - shared, 1) >= at_least
    new, out = np.ones(n, bool), []
    for first in range(n):
        if not new[first]:
            continue
        new[first], turn = False, [first]
        while turn:
            x = turn.pop()
            found = np.flatnonzero(near[x] & new)
            new[found] = False
            turn += found.tolist()
            out += [(x, y) for y in found.tolist() if roots[x] != roots[y]]
    return out


def _met(at_least: float):
    """Links of the blocks (bucket, i, j), whose rows follow each other."""

    def links(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(rows).combine_chunks()
        ids, roots = group.column("doc_id").to_numpy(), group.column("root").to_numpy()
        if len(ids) < 2 or (roots == roots[0]).all():
            return
        bag = group.column("bag").chunk(0)
        ends, flat = bag.offsets.to_numpy(), bag.values.to_numpy()
        pairs = forest([flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], roots, at_least)
        if pairs:
            x, y = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], axis=1)
            heads = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
            for x, y in zip(heads, [*heads[1:], len(batch)], strict=True):
                if last is not None and last != tuple(key[x]):
                    yield from links(held)
                    held = []
                last = tuple(key[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield from links(held)

    return run


def near_classes(docs: DataFrame, shingle: int = SHINGLE, at_least: float = LIKENESS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size, copy_of) for each distinct doc_id of docs(doc_id, text).

    class_id is the least doc_id of the connected class over links of likeness
    ``at_least``; copy_of is the least doc_id with the same text.  Equal texts
    are folded into one node first.  In each bucket of a band every node meets
    the bucket's head, by sketches and then by texts, and the links found are
    joined to classes.  Buckets whose nodes are in one class then are done.  In
    all others every two nodes are compared exactly, in blocks of bounded size:
    a node goes to each pair of blocks with its multiset of shingles, and a task
    gives back only links that join a block's classes, fewer than it has nodes.
    So no two nodes that share a bucket go untested unless a class joins them;
    the work of that last step grows with the square of the nodes of a bucket
    that one head does not join, the rows with that number over the block's.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = texts.withColumn("same", F.substring(F.sha2("text", 256), 1, 32)).mapInArrow(_signed(shingle, bands, rows), "doc_id long, same string, bands array<long>, sketch binary")
    signed = durable(signed)
    members = durable(signed.groupBy("doc_id").agg(F.min("same").alias("same")))
    members = durable(with_groups(members, members.groupBy("same").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")), "same").select("doc_id", "same", "copy_of"))
    signed = signed.join(members.where("doc_id = copy_of"), ["doc_id", "same"]).select("doc_id", "bands", "sketch").dropDuplicates(["doc_id"])
    nodes = signed.select("doc_id", F.explode("bands").alias("bucket"))
    heads = nodes.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    nodes = durable(nodes.join(heads, "bucket").select("bucket", "doc_id", "head", "n"))
    # texts and sketches of nodes that share a bucket: the others are read once and never again
    pool = durable(texts.join(nodes.select("doc_id").distinct(), "doc_id").join(signed.select("doc_id", "sketch"), "doc_id"))

    def side(name: str, column: str) -> DataFrame:
        return pool.select(F.col("doc_id").alias(name), F.col(column).alias(f"{column}_{name}"))

    pairs = nodes.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct().join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
    near = pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_perhaps(at_least, bands * rows), "a long, b long")
    both = near.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    links = durable(both.mapInArrow(_alike(shingle, at_least), "a long, b long, alike boolean").where("alike").select("a", "b"))
    labels = durable(classes(links))
    # a bucket of two is done; buckets of the same nodes are one
    at = nodes.where("n > 2").join(labels, nodes.doc_id == labels.node, "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    some = at.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("set"))
    some = some.where("r0 <> r1").groupBy("n", "set").agg(F.min("bucket").alias("bucket")).select("bucket")
    at = durable(at.join(some, "bucket"))
    bag = pool.join(at.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_elements(shingle), "doc_id long, bag array<long>")
    bag = durable(bag)
    full = at.join(bag.select("doc_id", F.size("bag").alias("size")), "doc_id").groupBy("bucket").agg(
        F.greatest(F.ceil(F.count("*") / NODES), F.ceil(F.sum("size") / ELEMENTS)).cast("int").alias("blocks")
    )
    own = at.join(full, "bucket").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = own.select("bucket", "doc_id", "root", "own", F.explode(other).alias("other")).join(bag, "doc_id")
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "root", "bag")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = durable(dealt.mapInArrow(_met(at_least), "a long, b long").distinct())
    labels = durable(classes(labels.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)))
    rooted = durable(members.join(labels, members.copy_of == labels.node, "left").select("doc_id", "copy_of", F.coalesce("root", "copy_of").alias("class_id")))
    sizes = rooted.groupBy("class_id").agg(F.count("*").alias("n"))
    return with_groups(rooted, sizes, "class_id").select("doc_id", "class_id", F.col("n").alias("class_size"), "copy_of")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs but for those whose class holds a smaller doc_id; null ids stay."""
    gone = near_classes(docs, **options).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
