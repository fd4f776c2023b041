"""Links of embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of t or more are at most 2 - 2t apart, squared. Rotated and split
into blocks, a pair must be within its proportional part of that in some block: otherwise the
parts would add up to more. So every block is a range join in few dimensions: a vector has a
home cell in a grid over the first dimensions of the block and visits the cells that its
ball touches. In a cell, home vectors are compared with all others within the block's
budget, those that no earlier block has found are verified by their exact cosine, and only
counts and a spanning tree of the links leave the task, never the pairs.

Equal vectors with equal labels are one class. A cell of more than ``chunk`` classes is dealt
out as pairs of chunks, so no task holds a whole crowded cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.llm.common import components, partitions, stored

COSINE = 0.98
BLOCK_DIMS = 8
#: Dimensions of a block that its grid uses. More make smaller cells and more visits (two a dimension).
GRID_DIMS = 2
CHUNK = 1500


@cache
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, which spreads distances evenly over blocks."""
    q, r = np.linalg.qr(np.random.default_rng(20_260).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, block_dims: int) -> list[tuple[int, int]]:
    return [(s, min(s + block_dims, dims)) for s in range(0, dims, block_dims)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.diff(b.column("embedding").offsets.to_numpy())
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, _vectors(b.column("embedding").take(pa.array(rows)))


def cells(classes: DataFrame, cosine: float, block_dims: int, grid_dims: int) -> DataFrame:
    """Every cell that a class is at home in or visits: uid, block, cell, home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _by_length(b):
                dims = x.shape[1]
                r = _unit(x) @ rotation(dims)
                uid = b.column("uid").to_numpy()[rows]
                for k, (lo, hi) in enumerate(blocks(dims, block_dims)):
                    radius = np.sqrt((2 - 2 * cosine) * (hi - lo) / dims) * (1 + 1e-6) + 1e-9
                    g = r[:, lo : min(hi, lo + grid_dims)]
                    home = np.floor(g / (2 * radius)).astype(np.int64)
                    low = np.floor((g - radius) / (2 * radius)).astype(np.int64)
                    high = np.floor((g + radius) / (2 * radius)).astype(np.int64)
                    # the ball touches two cells in each dimension, or one
                    for corner in product((0, 1), repeat=g.shape[1]):
                        at = np.where(np.array(corner) == 1, high, low)
                        fresh = np.all((high > low) | (np.array(corner) == 0), axis=1)
                        key = np.zeros(len(at), np.int64)
                        for d in range(at.shape[1]):
                            key = key * 4096 + (at[:, d] + 2048)
                        own = np.all(at == home, axis=1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(uid[fresh]), pa.array(np.full(fresh.sum(), k)), pa.array(key[fresh]), pa.array(own[fresh])],
                            ["uid", "block", "cell", "home"],
                        )

    return classes.select("uid", "embedding").mapInArrow(run, "uid long, block long, cell long, home boolean")


def linked(uid, copies, x, home, part, first, second, block, cosine, block_dims):
    """Within a cell: links that no earlier block finds. Number of vectors linked to each, and a root of each class."""
    n, dims = x.shape
    unit = _unit(x)
    r = unit @ rotation(dims)
    split = blocks(dims, block_dims)
    budget = np.array([(2 - 2 * cosine) * (hi - lo) / dims for lo, hi in split]) * (1 + 1e-9) + 1e-12
    lo, hi = split[block]
    here = r[:, lo:hi]
    square = (here * here).sum(axis=1)
    links, root = np.zeros(n, np.int64), np.arange(n)
    edges_a, edges_b = [], []
    rows = np.flatnonzero(home)
    for s in range(0, len(rows), 256):
        i = rows[s : s + 256]
        apart = square[i, None] + square[None] - 2 * here[i] @ here.T
        ok = (apart <= budget[block] + 1e-7) & (uid[i, None] < uid[None])
        # of two chunks, a pair is compared where both meet
        ok &= (np.minimum(part[i, None], part[None]) == first) & (np.maximum(part[i, None], part[None]) == second)
        a, b = np.nonzero(ok)
        a = i[a]
        for t in range(0, len(a), 20_000):
            p, q = a[t : t + 20_000], b[t : t + 20_000]
            d = np.add.reduceat((r[p] - r[q]) ** 2, [x for x, _ in split], axis=1)
            within = d <= budget
            new = within[:, block] & ~within[:, :block].any(axis=1)
            p, q = p[new], q[new]
            near = (unit[p] * unit[q]).sum(axis=1) >= cosine
            edges_a.append(p[near])
            edges_b.append(q[near])
    if not edges_a:
        return links, root
    a, b = np.concatenate(edges_a), np.concatenate(edges_b)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return links, root


def _found(met: DataFrame, cosine: float, block_dims: int) -> DataFrame:
    """Partial counts and edges of every cell: uid, links, other."""

    def solve(rows: list[tuple], key: tuple) -> Iterator[pa.RecordBatch]:
        uid, copies, home, part = (np.array([r[i] for r in rows]) for i in range(4))
        x = np.array([r[4] for r in rows], dtype=np.float64)
        _, _, block, _, first, second = key
        links, root = linked(uid, copies, x, home, part, first, second, block, cosine, block_dims)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(uid[root[some]])], ["uid", "links", "other"])

    keys = ["label", "dims", "block", "cell", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for b in batches:
            key_rows = zip(*(b.column(c).to_pylist() for c in keys))
            data = zip(*(b.column(c).to_pylist() for c in ("uid", "copies", "home", "part")), b.column("embedding"))
            for key, row in zip(key_rows, data):
                if key != last:
                    if len(rows) > 1:
                        yield from solve(rows, last)
                    last, rows = key, []
                rows.append((*row[:4], row[4].values.to_numpy(zero_copy_only=False)))
        if len(rows) > 1:
            yield from solve(rows, last)

    met = met.repartition(partitions(met.sparkSession), *keys).sortWithinPartitions(*keys)
    return met.select(*keys, "uid", "copies", "home", "part", "embedding").mapInArrow(run, "uid long, links long, other long")


def near_duplicates(
    vectors: DataFrame, *, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, grid_dims: int = GRID_DIMS, chunk: int = CHUNK
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their
    cosine in double precision is ``cosine`` or more. Null, empty and zero vectors, and those with
    null or non-finite components, link with nothing: n_links 0 and a component of their own.
    Repeated rows link with one another. component_id is the smallest known vec_id that
    links reach; kept is true where it is the row's own, null ids alike. Other columns are not
    read. No rows give none.
    """
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding"))
    sound = F.col("label").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    classes = rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")
    places = stored(cells(classes, cosine, block_dims, grid_dims), "cells")
    known = places.join(classes.select("uid", "label", F.size("embedding").alias("dims")), "uid")
    sizes = known.groupBy("label", "dims", "block", "cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    met = known.join(sizes.where("n > 1 and homes > 0"), ["label", "dims", "block", "cell"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("part", F.pmod(F.xxhash64("uid"), chunks).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.withColumn("first", F.least("part", "with")).withColumn("second", F.greatest("part", "with"))
    met = met.join(classes.select("uid", "copies", "embedding"), "uid")
    found = stored(_found(met, cosine, block_dims), "links")

    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    nodes = classes.join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    smallest = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(smallest, "component").join(counts, "uid", "left")
    nodes = nodes.select("label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    good = rows.where(sound).join(nodes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
