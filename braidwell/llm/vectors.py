"""Blocks of vectors, one row each, and joins of block pairs.

Blocks are dealt to groups of up to ``STRIPE``. A cell is an unordered pair of groups and one task's work: it gets the
blocks of both once, visits their block pairs for both directions, and returns what is best of each query over the
whole cell. So of n blocks n / STRIPE copies are shipped of each, and a query has one list a cell and not one a pair.

A vector counts if its id isn't null, it isn't null, has the dimension that most vectors have (of equally
frequent ones the largest) and only finite numbers. Rows that share an id count once, with the smallest
vector in array order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
STRIPE = 16
_MOST_TASKS = 100_000
BLOCK_FIELDS = "block long, n int, ids binary, vectors binary"


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that count, and their dimension (0: there are none)."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < float('inf'))")
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return rows.limit(0), 0
    return rows.where(F.size("embedding") == sizes.d).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), sizes.d


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)


def packed(rows: DataFrame, dimension: int, count: int, order: Column | None = None, size: int = BLOCK) -> DataFrame:
    """Blocks of about ``size`` vectors: by a hash of the id, or by ``order``, in which they are then also numbered."""
    parts = max(1, math.ceil(count / size))
    spread = rows.repartition(parts, "vec_id") if order is None else rows.repartitionByRange(parts, order, "vec_id")
    spread = spread.withColumn("part", F.spark_partition_id().cast("long"))
    spread = spread.sortWithinPartitions(*(("vec_id",) if order is None else (order, "vec_id")))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        part = table.column("part")[0].as_py()
        for k, at in enumerate(range(0, table.num_rows, 2 * size)):  # a part much over size is cut
            piece = table.slice(at, 2 * size)
            ids = np.ascontiguousarray(piece.column("vec_id").to_numpy())
            vectors = matrix(piece.column("embedding").combine_chunks(), dimension)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 20) + k]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], names=["block", "n", "ids", "vectors"])

    return spread.select("part", "vec_id", "embedding").mapInArrow(run, BLOCK_FIELDS)


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.float32).reshape(len(ids), -1)


def grouped(blocks: DataFrame, count: int, size: int = BLOCK) -> tuple[DataFrame, int]:
    """``blocks`` of a table of ``count`` vectors with their group ``g``, and how many groups there are. Groups are smaller where few
    blocks would leave cores without a cell."""
    parts = max(1, math.ceil(count / size))
    most = math.ceil(math.sqrt(6 * blocks.sparkSession.sparkContext.defaultParallelism))
    per = max(1, min(STRIPE, math.ceil(parts / most)))
    return blocks.withColumn("g", F.floor(F.shiftright("block", 20) / per).cast("long")), math.ceil(parts / per)


def in_cells(blocks: DataFrame, groups: int, run, schema: str, pairs: DataFrame | None = None) -> DataFrame:
    """``run``, a function of a cell's blocks (sorted, with their groups), over all cells, or over the group ``pairs`` (a, b)."""
    if pairs is None:
        a, b = F.least("g", "other"), F.greatest("g", "other")
        placed = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("cell", a * groups + b).drop("other")
    else:
        placed = blocks.join(pairs.select((F.col("a") * groups + F.col("b")).alias("cell"), F.explode(F.array_distinct(F.array("a", "b"))).alias("g")), "g")
    placed = placed.repartition(min(_MOST_TASKS, groups * (groups + 1) // 2), "cell")
    return placed.groupBy("cell").applyInArrow(lambda table: run(table.sort_by("block")), schema)


def cell_pairs(groups: list[int], cell: int, count: int):
    """Unordered pairs (i, j) of a cell's blocks, given their groups; i == j is a block with itself."""
    low, high = divmod(cell, count)
    for i, g in enumerate(groups):
        for j, h in enumerate(groups):
            if (g, h) == (low, high) and (g != h or i <= j):
                yield i, j


class Lists:
    """The k pairs of least cost of each query of one block, as they come in."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.other, self.cost = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, other: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries that have k, and their k-th cost."""
        q, o, c = np.concatenate([self.query, query]), np.concatenate([self.other, other]), np.concatenate([self.cost, cost])
        keep = best(q, np.arange(len(o)), c, o, self.k)
        self.query, self.other, self.cost = q[keep], o[keep], c[keep]
        queries, begin, n = np.unique(self.query, return_index=True, return_counts=True)
        full = n >= self.k
        return queries[full], self.cost[begin[full] + self.k - 1]


def best(query: np.ndarray, other: np.ndarray, cost: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k pairs of least cost (ties: least id) of each query, sorted by query and cost."""
    order = np.lexsort((ids[other], cost, query))
    q = query[order]
    new = np.concatenate([[True], q[1:] != q[:-1]])
    start = np.flatnonzero(new)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]
