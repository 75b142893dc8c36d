"""Nearest neighbours by Euclidean distance: a block matrix join on int8 products with error bounds.

A vector x is held as int8 codes c with a scale s; e = |x - s c| is what that loses. For two vectors,
s s' (c . c') differs from the inner product by at most |s c| e' + e |x'|, so an int8 product tile gives a lower
and an upper bound of every squared distance of the block pair. (Tiles are float32 matrix products of the
codes: sums of int8 products stay below 2^24, where float32 is exact, for up to 1,040 dimensions; longer
vectors are summed in parts.) A first pass joins each block with itself and gives every query an upper bound
of its k-th distance. Then each unordered block pair is visited once, for both directions, in cells of block
groups (see ``vectors``): pairs whose lower bound exceeds both limits are dropped, the survivors' distances are
recomputed in float64, limits fall with what a cell has found, and per query a heap merges the cells' lists to the k
nearest. Nothing is dropped that could be among the k nearest, so the result equals brute force.

Every row is a query and isn't its own neighbour. Distances are rounded to six decimals; ties go to the
smaller id. Defined cases: see ``vectors``; vectors that don't count are neither queries nor neighbours. Vectors of any
dimension are compared whole. With fewer than k others a query has fewer rows. Other columns, whatever their names, don't
matter. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.llm.common import Scratch, read_table
from braidwell.llm.vectors import BLOCK, Lists, best, cell_pairs, grouped, in_cells, packed, unpack, usable

K = 10
RUN = 1024
_EXACT = 1024  # dimensions whose int8 products sum exactly in float32


class Quantised:
    """int8 codes of vectors with scale, norms and error of each."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.float64)
        self.x, self.scale = x, np.abs(x).max(1) / 127
        safe = np.where(self.scale > 0, self.scale, 1)
        self.codes = np.rint(x / safe[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.error, self.near, self.norm = np.linalg.norm(x - near, axis=1), np.linalg.norm(near, axis=1), np.linalg.norm(x, axis=1)

    def take(self, at: slice) -> Quantised:
        out = object.__new__(Quantised)
        for name, value in self.__dict__.items():
            setattr(out, name, value[at])
        return out


def int8_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    if a.shape[1] <= _EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, i : i + _EXACT].astype(np.float32) @ b[:, i : i + _EXACT].astype(np.float32).T).astype(np.float64) for i in range(0, a.shape[1], _EXACT))


def bounds(q: Quantised, x: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance by the codes, its error bound) of all pairs."""
    product = int8_tile(q.codes, x.codes) * (q.scale[:, None] * x.scale[None, :]).astype(np.float32)
    middle = (q.norm**2)[:, None].astype(np.float32) + (x.norm**2)[None, :].astype(np.float32) - 2 * product
    error = 2 * (np.outer(q.near, x.error) + np.outer(q.error, x.norm)).astype(np.float32)
    error += (4e-6 * (q.norm.max(initial=0) + x.norm.max(initial=0)) ** 2 + 2e-6)  # float32, and rounded distances
    return middle, error


def nearest(qid, q: Quantised, xid, x: Quantised, limit: np.ndarray, k: int):
    """(query, neighbour, distance) positions: the k nearest of each query below its limit of the squared distance."""
    limit = limit.copy()
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at in range(0, len(xid), RUN):
        part = x.take(slice(at, at + RUN))
        middle, error = bounds(q, part)
        if part.codes.shape[0] > k + 1:  # the k-th smallest upper bound here also limits (one may be the query itself)
            upper = np.partition(middle + error, k, axis=1)[:, k]
            limit = np.minimum(limit, upper + 1e-5)
        a, b = np.nonzero(middle - error <= limit[:, None])
        b = b + at
        other = qid[a] != xid[b]
        a, b = a[other], b[other]
        d = np.concatenate([((q.x[a[i : i + (1 << 16)]] - x.x[b[i : i + (1 << 16)]]) ** 2).sum(1) for i in range(0, len(a), 1 << 16)] or [np.zeros(0)])
        found = tuple(np.concatenate(z) for z in zip(found, (a, b, np.round(np.sqrt(d), 6))))
        keep = best(found[0], found[1], found[2], xid, k)
        found = tuple(z[keep] for z in found)
        queries, begin, n = np.unique(found[0], return_index=True, return_counts=True)
        full = n >= k
        limit[queries[full]] = np.minimum(limit[queries[full]], (found[2][begin[full] + k - 1] + 1e-6) ** 2 + 1e-9)
    return found, limit


def _seed(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, vectors = unpack(r["ids"], r["vectors"])
                q = Quantised(vectors)
                (a, b, d), limit = nearest(ids, q, ids, q, np.full(len(ids), np.inf), k)
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]]), "ids": [r["ids"]], "vectors": [r["vectors"]], "limits": [limit.tobytes()], "g": pa.array([r["g"]])})

    return run


def lower_bounds(left: np.ndarray, right: np.ndarray, margin: float) -> np.ndarray:
    """Lower bounds of the squared distances of all pairs, as one product of ``sides``."""
    out = left @ right.T
    out -= np.float32(margin)
    return out


def sides(x: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Rows of which the product of one's left and another's right one is ``bounds``' middle less its error, before ``margin``."""
    near, one = (x.codes * x.scale[:, None]).astype(np.float32), np.ones(len(x.scale), np.float32)
    column = lambda *c: np.stack(c, 1).astype(np.float32)
    return np.hstack([near, column(x.norm**2, one, x.near, x.error)]), np.hstack([-2 * near, column(one, x.norm**2, -2 * x.error, -2 * x.norm)])


def margin(q: Quantised, x: Quantised) -> float:
    """What float32 may lose of such a product: a rounding per factor and one per sum, of terms of (|q| + |x|)^2 together."""
    most = q.norm.max(initial=0) + x.norm.max(initial=0) + q.error.max(initial=0) + x.error.max(initial=0)
    return (q.x.shape[1] + 16) * 1.2e-7 * most**2 + 2e-6


def near_pairs(q: Quantised, x: Quantised, q_limit: np.ndarray, x_limit: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(q position, x position, distance) of the pairs of two blocks that either side's limit of the squared distance allows."""
    lost, high = margin(q, x), q_limit[:, None].astype(np.float32)
    for at in range(0, len(x.scale), RUN):
        lower = lower_bounds(left, right[at : at + RUN], lost)
        hit = lower <= high
        hit |= lower <= x_limit[None, at : at + RUN].astype(np.float32)
        a, b = np.nonzero(hit)
        b += at
        d = np.concatenate([((q.x[a[i : i + (1 << 16)]] - x.x[b[i : i + (1 << 16)]]) ** 2).sum(1) for i in range(0, len(a), 1 << 16)] or [np.zeros(0)])
        yield a, b, np.round(np.sqrt(d), 6)


def _search(groups: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        of, cell = table.column("g").to_pylist(), table.column("cell")[0].as_py()
        ids, vectors = zip(*(unpack(i, v) for i, v in zip(table.column("ids").to_pylist(), table.column("vectors").to_pylist())))
        held = [Quantised(v) for v in vectors]
        left, right = zip(*map(sides, held))
        limits = [np.frombuffer(x, np.float64) * (1 + 1e-6) + 1e-6 for x in table.column("limits").to_pylist()]  # above their float32
        lists = [Lists(len(i), k) for i in ids]
        for i, j in cell_pairs(of, cell, groups):
            for a, b, d in near_pairs(held[i], held[j], limits[i], limits[j], left[i], right[j]):
                for me, query, other, there in ((i, a, b, j), (j, b, a, i))[: 1 + (i != j)]:
                    near = (d * d <= limits[me][query] + 1e-5) & (ids[me][query] != ids[there][other])
                    full, worst = lists[me].add(query[near], ids[there][other[near]], d[near])
                    limits[me][full] = np.minimum(limits[me][full], (worst + 1e-6) ** 2 * (1 + 1e-6) + 1e-6)
        return pa.table({"vec_id": np.concatenate([i[x.query] for i, x in zip(ids, lists)]), "neighbour_id": np.concatenate([x.other for x in lists]), "distance": np.concatenate([x.cost for x in lists])})

    return run


def _heaps(k: int):
    """Rows sorted by query to the k nearest of each, by a heap."""

    def merged(q: np.ndarray, x: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rows, ds, xs = [], d.tolist(), x.tolist()
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(q)]):
            rows += [(a, n, other, i) for i, (n, other) in enumerate(heapq.nsmallest(k, zip(ds[a:b], xs[a:b])), 1)]
        at, n, other, i = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(q[list(at)]), pa.array(other, pa.int64()), pa.array(n, pa.float64()), pa.array(i, pa.int32())], names=["vec_id", "neighbour_id", "distance", "rank"])

    def run(batches):
        left = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            left = tuple(np.concatenate([a, c.to_numpy()]) for a, c in zip(left, batch.columns))
            if len(left[0]):
                cut = int(np.searchsorted(left[0], left[0][-1]))  # the last query may go on
                if cut:
                    yield merged(*(x[:cut] for x in left))
                    left = tuple(x[cut:] for x in left)
        if len(left[0]):
            yield merged(*left)

    return run


def neighbours(spark: SparkSession, table: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """vec_id, neighbour_id, distance and rank: the k nearest of each vector."""
    scratch = Scratch(spark)
    rows, dimension = usable(table)
    rows = scratch.table(rows, "rows")
    count = rows.count()
    if not count:
        return rows.selectExpr("vec_id", "vec_id AS neighbour_id", "double(0) AS distance", "int(0) AS rank").limit(0)
    blocks, groups = grouped(scratch.table(packed(rows, dimension, count, size=block), "blocks"), count, block)
    limited = blocks.repartition(max(1, math.ceil(count / block)), "block").mapInArrow(_seed(k), "block long, ids binary, vectors binary, limits binary, g long")
    found = in_cells(scratch.table(limited, "seeded"), groups, _search(groups, k), "vec_id long, neighbour_id long, distance double")
    return found.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(_heaps(k), "vec_id long, neighbour_id long, distance double, rank int")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, read_table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH scored AS (
    SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM scored
)
SELECT vec_id, neighbour_id, distance, rank FROM ranked WHERE rank <= {K}
"""
