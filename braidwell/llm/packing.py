"""Packing of token sequences into bins of fixed capacity by minimum bin slack.

A document of n tokens gives n // capacity pieces that fill a bin each, and a rest. Rests are packed in
shards of about ``SHARD_TOKENS`` tokens, chosen by a hash of doc_id and text, so any number of executors work side by
side and a shard fits one task at every corpus size. Within a shard each bin takes the longest rest left and,
beside it, the fullest feasible combination of the lengths still available: a bitset (one big integer) of
reachable sums is extended by each length, as often as there are rests of it, until the capacity is reached
or the lengths end. The combination is removed, as many times as the counts allow at once.

Defined cases: null and empty texts have no tokens and are in no bin. Rows with a null doc_id are packed,
with a null doc_id; they are dealt out by their texts. Repeated rows are packed one by one. Equal lengths are taken by
doc_id, null ids last. Texts of any length are packed whole. Other columns, whatever their names, don't matter. An
empty table gives no bins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.llm.common import Scratch, read_table
from braidwell.llm.tokens import VOCABULARY, with_lengths

CAPACITY = 4096
SHARD_TOKENS = 1 << 24
_OUT = "bin_id long, position int, doc_id long, token_start long, n_tokens long, bin_offset long"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best, each used at most ``counts`` times. lengths: descending."""
    reach, goal, mask, log = 1, 1 << room, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        left, part = min(counts[n], room // n), 1
        while left > 0 and not reach & goal:
            some = min(part, left)
            log.append((n, some, reach))
            reach |= (reach << (n * some)) & mask
            left -= some
            part *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for n, some, before in reversed(log):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + some
            total -= n * some
    return used


def patterns(counts: dict[int, int], capacity: int):
    """Combinations that use all rests, with how many bins each fills: [(lengths, times)]."""
    counts = dict(counts)
    order = sorted(counts, reverse=True)
    while order:
        first = order[0]
        counts[first] -= 1
        used = fullest(order, counts, capacity - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        order = [n for n in order if counts[n]]
        yield sorted(used.items(), reverse=True), times


def _pack(capacity: int):
    names = [x.split()[0] for x in _OUT.split(", ")]

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "ascending"), ("doc_id", "ascending")])  # null ids come last
        base = table.column("shard")[0].as_py() << 40
        n = table.column("n_tokens").to_numpy()
        full = n // capacity
        rows = np.repeat(np.arange(len(n)), full)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        rest, queue = n % capacity, {}
        for i in np.flatnonzero(rest):
            queue.setdefault(int(rest[i]), []).append(int(i))
        next_of = dict.fromkeys(queue, 0)
        bins, places, members, sizes, offsets = [], [], [], [], []
        number = base + len(rows)
        for used, times in patterns({k: len(v) for k, v in queue.items()}, capacity):
            for _ in range(times):
                place = offset = 0
                for size, k in used:
                    for _ in range(k):
                        members.append(queue[size][next_of[size]])
                        next_of[size] += 1
                        bins.append(number)
                        places.append(place)
                        sizes.append(size)
                        offsets.append(offset)
                        place, offset = place + 1, offset + size
                number += 1
        long = lambda *x: np.concatenate([np.asarray(v, np.int64) for v in x])
        none, of = np.zeros(len(rows), np.int64), np.array(members, np.int64)
        out = [
            pa.array(long(base + np.arange(len(rows)), bins)),
            pa.array(long(none, places), pa.int64()).cast(pa.int32()),
            table.column("doc_id").combine_chunks().take(pa.array(long(rows, members))),  # by row number: ids stay as they are
            pa.array(long(step * capacity, full[of] * capacity)),
            pa.array(long(none + capacity, sizes)),
            pa.array(long(none, offsets)),
        ]
        return pa.Table.from_arrays(out, names=names)

    return shard


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: its bin, place in the bin, document, first token in the document and length."""
    scratch = Scratch(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text", F.lit(29)).alias("place"), "text")
    sized = scratch.table(with_lengths(sized, ["doc_id", "place"], vocabulary).where("n_tokens > 0"), "sized")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    placed = sized.select("doc_id", "n_tokens", F.pmod("place", F.lit(shards)).alias("shard"))
    return placed.groupBy("shard").applyInArrow(_pack(capacity), _OUT)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read_table(spark, sf_dir, "documents"))
