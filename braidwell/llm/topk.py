"""Exact top-k by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

All vectors are rotated by the eigenvectors of their second-moment matrix (the right singular vectors of the
table), so the first coordinates carry most of every product. They are sorted by length into blocks. A first
pass joins each block of queries with itself and with the block of the longest vectors, which gives every
query a lower bound of its k-th best score. Pairs of block groups (see ``vectors``) are dropped by the groups' largest
lengths and smallest bounds alone, before any vector is shipped; the block pairs of the others are visited once, for both
directions, longest vectors first: in runs of descending length, inner products are summed over the leading coordinates
and a pair is pruned as soon as the partial sum plus the product of the remaining lengths (Cauchy-Schwarz) is below the
bounds of both sides, which rise with what is found. Survivors are scored in double precision from the original
vectors. Per query, the cells' lists are merged.

Every row is a query and its own vector isn't among its neighbours. Scores are rounded to six decimals and
ties go to the smaller id. Bounds are widened by the rounding, so pruning never loses a pair.

Defined cases: see ``vectors``; vectors that don't count are neither queries nor neighbours. Zero vectors
score 0 with everything. Vectors of equal length are ranged by id. Vectors of any dimension are compared whole. With fewer
than k others a query has fewer rows. Other columns, whatever their names, don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwell.llm.common import Scratch, read_table
from braidwell.llm.vectors import BLOCK, Lists, best, cell_pairs, grouped, in_cells, matrix, packed, unpack, usable

K = 10
RUN = 1024
_PAIR = "vec_id long, neighbour_id long, score double"


def rotation(rows: DataFrame, dimension: int) -> np.ndarray:
    """Right singular vectors by falling singular value. Only dimension^2 sums reach the driver."""

    def run(batches):
        total = np.zeros((dimension, dimension))
        for b in batches:
            m = matrix(b.column(0), dimension).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension**2)), pa.array(total.ravel())], names=["i", "x"])

    sums = rows.select("embedding").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
    _, vectors = np.linalg.eigh(sums.x.to_numpy().reshape(dimension, dimension))
    return vectors[:, ::-1].astype(np.float32)


def tile(qid, q, xid, x, floor, turn, k: int):
    """(query, neighbour, score) positions and scores of one block pair: the k best above each query's floor."""
    d = q.shape[1]
    qr, xr = q @ turn, x @ turn
    q64, x64 = q.astype(np.float64), x.astype(np.float64)
    qn, xn = np.linalg.norm(q64, axis=1), np.linalg.norm(x64, axis=1)
    floor = floor.copy()
    slack = 2e-6 + 1e-5 * qn * (xn.max() if len(xn) else 0)  # rounding of scores, and of float32 partial sums
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(-xn, kind="stable")
    steps = _steps(d)
    for at in range(0, len(order), RUN):
        xi = order[at : at + RUN]
        live = np.flatnonzero(qn * xn[xi[0]] >= floor - slack)
        if not len(live):
            break  # vectors only get shorter
        part, done = np.zeros((len(live), len(xi)), np.float32), 0
        low = (floor - slack)[live].astype(np.float32)[:, None]
        for s in steps:
            part += qr[live, done:s] @ xr[xi, done:s].T
            done = s
            rest = np.outer(np.linalg.norm(qr[live, s:], axis=1), np.linalg.norm(xr[xi, s:], axis=1)) if s < d else np.float32(0)
            hit = part + rest >= low
            if s == d or hit.mean() < 0.02:
                break
        a, b = np.nonzero(hit)
        a, b = live[a], xi[b]
        other = qid[a] != xid[b]
        a, b = a[other], b[other]
        if done == d and len(a) > 50 * k * max(1, len(live)):  # bounds still open: the k best by float32 narrow it first
            keep = np.argpartition(-part, min(2 * k + 8, part.shape[1] - 1), axis=1)[:, : 2 * k + 8]
            kth = np.sort(np.take_along_axis(part, keep, 1), axis=1)[:, max(0, keep.shape[1] - k - 1)]
            fine = part >= np.maximum(low[:, 0], kth - 2 * slack[live].astype(np.float32))[:, None]
            a, b = np.nonzero(fine)
            a, b = live[a], xi[b]
            other = qid[a] != xid[b]
            a, b = a[other], b[other]
        score = np.concatenate([np.einsum("ij,ij->i", q64[a[i : i + (1 << 16)]], x64[b[i : i + (1 << 16)]]) for i in range(0, len(a), 1 << 16)] or [np.zeros(0)])
        found = tuple(np.concatenate(z) for z in zip(found, (a, b, np.round(score, 6) + 0.0)))
        keep = best(found[0], found[1], -found[2], xid, k)
        found = tuple(z[keep] for z in found)
        queries, begin, n = np.unique(found[0], return_index=True, return_counts=True)
        full = n >= k
        floor[queries[full]] = np.maximum(floor[queries[full]], found[2][begin[full] + k - 1])
    return found


def _seed(turn, k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qid, q = unpack(r["ids"], r["vectors"])
                floor = np.full(len(qid), -np.inf)
                got = tile(qid, q, qid, q, floor, turn, k)
                if r["block"] != r["top"]:
                    xid, x = unpack(r["top_ids"], r["top_vectors"])
                    more = tile(qid, q, xid, x, floor, turn, k)
                    a, s = np.concatenate([got[0], more[0]]), np.concatenate([got[2], more[2]])
                else:
                    a, s = got[0], got[2]
                order = np.lexsort((-s, a))
                a, s = a[order], s[order]
                queries, begin, n = np.unique(a, return_index=True, return_counts=True)
                floor[queries[n >= k]] = s[begin[n >= k] + k - 1]
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]]), "ids": [r["ids"]], "vectors": [r["vectors"]], "floors": [floor.tobytes()], "longest": [float(np.linalg.norm(q.astype(np.float64), axis=1).max())], "lowest": [float(floor.min())], "g": pa.array([r["g"]])})

    return run


class Side:
    """A block as one side of block pairs: its vectors by falling length, their rotation and what is left after each step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, turn: np.ndarray, steps: list[int]):
        x = vectors.astype(np.float64)
        length = np.linalg.norm(x, axis=1)
        order = np.argsort(-length, kind="stable")
        self.ids, self.x, self.length, self.floors = ids[order], x[order], length[order], floors[order].copy()
        self.turned = (vectors @ turn)[order]
        self.rest = [np.linalg.norm(self.turned[:, s:], axis=1) for s in steps]


def _steps(d: int) -> list[int]:
    return sorted({max(1, d // 4), max(1, d // 2), d})


def good_pairs(q: Side, x: Side, steps: list[int]):
    """(q position, x position, score) of the pairs of two blocks that either side's floor allows, in runs of falling length."""
    slack = lambda a, b: 2e-6 + 1e-5 * a * b  # noqa: E731  # rounding of scores, and of float32 partial sums
    for at in range(0, len(x.ids), RUN):
        run = np.arange(at, min(at + RUN, len(x.ids)))
        q_low, x_low = q.floors - slack(q.length, x.length[at]), (x.floors - slack(x.length, q.length[0]))[run]
        q_open, x_open = q.length * x.length[at] >= q_low, x.length[run] * q.length[0] >= x_low
        if not (q_open.any() or x_open.any()):
            continue
        rows = np.flatnonzero(q_open) if not x_open.any() else np.arange(len(q.ids))
        if not q_open.any():
            run, x_low = run[x_open], x_low[x_open]
        low, x_low = q_low[rows, None].astype(np.float32), x_low[None].astype(np.float32)
        part, done = np.zeros((len(rows), len(run)), np.float32), 0
        for s, q_rest, x_rest in zip(steps, q.rest, x.rest):
            part += q.turned[rows, done:s] @ x.turned[run, done:s].T
            most = part + np.outer(q_rest[rows], x_rest[run]) if s < steps[-1] else part
            hit = (most >= low) | (most >= x_low)
            done = s
            if hit.mean() < 0.02:
                break
        a, b = np.nonzero(hit)
        a, b = rows[a], run[b]
        score = np.concatenate([np.einsum("ij,ij->i", q.x[a[i : i + (1 << 16)]], x.x[b[i : i + (1 << 16)]]) for i in range(0, len(a), 1 << 16)] or [np.zeros(0)])
        yield a, b, np.round(score, 6) + 0.0


def _search(turn, groups: int, k: int):
    steps = _steps(len(turn))

    def run(table: pa.Table) -> pa.Table:
        of, cell = table.column("g").to_pylist(), table.column("cell")[0].as_py()
        held = [Side(*unpack(i, v), np.frombuffer(f, np.float64), turn, steps) for i, v, f in zip(*(table.column(c).to_pylist() for c in ("ids", "vectors", "floors")))]
        lists = [Lists(len(h.ids), k) for h in held]
        for i, j in cell_pairs(of, cell, groups):
            for a, b, score in good_pairs(held[i], held[j], steps):
                for me, query, there, other in ((i, a, j, b), (j, b, i, a))[: 1 + (i != j)]:
                    good = (score >= held[me].floors[query]) & (held[me].ids[query] != held[there].ids[other])
                    full, worst = lists[me].add(query[good], held[there].ids[other[good]], -score[good])
                    held[me].floors[full] = np.maximum(held[me].floors[full], -worst)
        return pa.table({"vec_id": np.concatenate([h.ids[x.query] for h, x in zip(held, lists)]), "neighbour_id": np.concatenate([x.other for x in lists]), "score": np.concatenate([-x.cost for x in lists]) + 0.0})

    return run


def top_k(spark: SparkSession, table: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """vec_id, neighbour_id, score and rank: the k best of each vector."""
    scratch = Scratch(spark)
    rows, dimension = usable(table)
    rows = scratch.table(rows, "rows")
    count = rows.count()
    if not count:
        return rows.selectExpr("vec_id", "vec_id AS neighbour_id", "double(0) AS score", "int(0) AS rank").limit(0)
    turn = rotation(rows, dimension)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    blocks, groups = grouped(scratch.table(packed(rows, dimension, count, (-length).alias("o"), block), "blocks"), count, block)
    first = blocks.agg(F.min("block")).first()[0]
    top = blocks.where(F.col("block") == first).select(F.col("block").alias("top"), F.col("ids").alias("top_ids"), F.col("vectors").alias("top_vectors"))
    seeded = blocks.repartition(max(1, math.ceil(count / block)), "block").crossJoin(F.broadcast(top))  # one block, of fixed size
    seeded = scratch.table(seeded.mapInArrow(_seed(turn, k), "block long, ids binary, vectors binary, floors binary, longest double, lowest double, g long"), "seeded")
    bounds = seeded.groupBy("g").agg(F.max("longest").alias("longest"), F.min("lowest").alias("lowest"))  # two numbers a group
    a, b = (bounds.select(*(F.col(c).alias(f"{side}{c}") for c in bounds.columns)) for side in ("a_", "b_"))
    reach = F.col("a_longest") * F.col("b_longest") * (1 + 1e-5) + 2e-6
    pairs = a.join(b, (F.col("a_g") <= F.col("b_g")) & (reach >= F.least("a_lowest", "b_lowest"))).select(F.col("a_g").alias("a"), F.col("b_g").alias("b"))
    found = in_cells(seeded, groups, _search(turn, groups, k), _PAIR, pairs)
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read_table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH scored AS (
    SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id)::INTEGER AS rank FROM scored
)
SELECT vec_id, neighbour_id, score, rank FROM ranked WHERE rank <= {K}
"""
