"""SimHash near-duplicate removal by a binary-trie self-join.

Every document gets a 256-bit SimHash of its distinct words and word pairs; in scripts written without spaces
every letter is a word, so they are letters and letter pairs. Copies of one fingerprint
collapse first, so a group of thousands of exact copies is one trie entry. Fingerprints are then joined
with themselves: the trie of all fingerprints, its bits taken in an order of its own per table, is cut
below its first ``w`` bits into subtries, and in each subtrie pairs of nodes are traversed together, down to the last
bit; the differing bits of a node pair are accumulated on the way down and a pair is dropped as soon as they
exceed the budget. Pairs that reach the leaves are within the budget exactly. They are joined to components as they
come, and node pairs within one component are passed over, so a group of thousands of near copies isn't enumerated. A near copy whose bits
differ in share p meets its partner in one subtrie with a probability of about (1-p)^w; the number of tables makes
the chance of missing it in all of them less than ``miss`` at p = ``differ``, by default the budget itself, so it
holds for every pair within the budget at every corpus size. ``w`` is nine bits less than the
logarithm of the number of fingerprints, so subtries hold about 512 at any corpus size: more would cost more
pairs, fewer more tables, and every table ships each fingerprint once.

Groups are the connected components of the pairs; the smallest doc_id of a group stays.

Defined cases: a null or empty text, or one without any word, is in no group. Rows with a null doc_id are
in no group. Rows that share a doc_id are one document: they stay or go together. Texts of any length are
fingerprinted whole. Of equal fingerprints, and in every group, the smallest doc_id stays, so there are no ties. Columns
besides doc_id and text, whatever their names, don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.llm.common import Scratch, Words, drop_ids, mix, read_table, slices, text_buffers

WORDS = 4  # 64-bit words of a fingerprint
BITS = 64 * WORDS
BUDGET = 50
DIFFER = BUDGET / BITS
MISS = 0.03
_COLUMNS = [f"f{i}" for i in range(WORDS)]
_U = np.uint64
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) fingerprints and how many distinct features each text has."""
    n = len(offsets) - 1
    words = Words(raw, offsets, by_class=True)
    h = words.hashes()
    pair = mix(h[:-1] * _U(0xD6E8FEB86659FD93) + h[1:], 7) if len(h) > 1 else h[:0]
    same = words.doc[:-1] == words.doc[1:]
    feature = np.concatenate([h, pair[same]]) >> _U(20)
    doc = np.concatenate([words.doc, words.doc[:-1][same]]).astype(np.uint64)
    key = np.unique((doc << _U(44)) | feature)
    doc = (key >> _U(44)).astype(np.int64)
    out = np.empty((n, WORDS * 8), np.uint8)
    for i in range(WORDS):
        wide = mix(key & _U((1 << 44) - 1), 11 + i)
        for b in range(8):
            byte = ((wide >> _U(8 * b)) & _U(255)).astype(np.int64)
            votes = np.bincount(doc * 256 + byte, minlength=n * 256).reshape(n, 256).astype(np.float32) @ _BITS_OF
            out[:, i * 8 + b] = np.packbits(votes > 0, axis=1)[:, 0]
    return out.view(np.uint64).reshape(n, WORDS), np.bincount(doc, minlength=n)


def _sign(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets, _ = text_buffers(part.column(1))
            prints, features = fingerprints(raw, offsets)
            keep = np.flatnonzero(features > 0)
            rows = [part.column(0).take(pa.array(keep)).cast(pa.int64())]
            rows += [pa.array(prints[keep, i].view(np.int64)) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", *_COLUMNS])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint words f0..f3 of the texts that have a word."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return narrow.mapInArrow(_sign, "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS))


def layout(count: int, differ: float = DIFFER, miss: float = MISS) -> tuple[int, int]:
    """Bits above the cut and number of tables for ``count`` fingerprints."""
    w = min(40, max(4, math.ceil(math.log2(max(count, 2))) - 9))
    bits = min(round(differ * BITS), BITS - w)
    meet = math.comb(BITS - bits, w) / math.comb(BITS, w)  # none of the w bits is one that differs
    return w, math.ceil(math.log(miss) / math.log1p(-meet)) if meet < 1 else 1


def bit_order(table: int) -> np.ndarray:
    return np.random.default_rng(1000 + table).permutation(BITS)


def _spread(w: int, tables: int):
    """Each fingerprint once per table, its bits in the table's order, with the subtrie it falls in."""
    orders = [bit_order(t) for t in range(tables)]

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.stack([batch.column(i + 1).to_numpy().view(np.uint64) for i in range(WORDS)], axis=1)
            bits = np.unpackbits(prints.view(np.uint8), axis=1)
            for t, order in enumerate(orders):
                turned = np.ascontiguousarray(np.packbits(bits[:, order], axis=1))
                words = turned.view(">u8").astype(np.uint64)
                key = (words[:, 0] >> _U(64 - w)).astype(np.int64) * tables + t
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column(0), *(pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(WORDS))],
                    names=["key", "doc_id", *_COLUMNS],
                )

    return rows


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers of all ranges [begin, begin + count), one after another."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


class Components:
    """Connected components of 0..n-1 as pairs come in; ``label`` is the smallest member of each one's component."""

    def __init__(self, n: int):
        self.label, self.turn = np.arange(n), 0

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        label = self.label
        left, right = label[left], label[right]
        live = left != right
        if not live.any():
            return
        self.turn += 1
        while True:
            left, right = left[live], right[live]
            if not len(left):
                return
            low = np.minimum(label[left], label[right])
            np.minimum.at(label, label[left], low)
            np.minimum.at(label, label[right], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
            live = label[left] != label[right]


def trie_join(prints: np.ndarray, group: np.ndarray, skip: int, budget: int, most: int = 1 << 18, joined: Components | None = None, seen: dict | None = None):
    """Pairs (i, j, differing bits), i < j, of one group within the budget. Rows are sorted by group and bits.

    A node is a run of rows with equal leading bits; eight binary levels are walked at once, down to the last bit or
    until every node is one row. The first ``skip`` bits are those the group shares. Paths are compressed: a pair of
    nodes of one row each goes straight to its leaves, by words of 64 bits. Both ways add up the differing bits and drop a
    pair as soon as they exceed the budget. Node pairs wait on a stack in blocks of at most ``most`` children, so memory is
    bounded however large a subtrie is.

    With ``joined``, kept by whoever takes the pairs, node pairs all of whose rows are in one component already are
    dropped too, so a large group of near copies costs little more than a pair a row. ``seen`` counts node pairs met and
    pruned above the leaves, leaf pairs and those pruned.
    """
    n = len(prints)
    if n < 2:
        return
    small = np.int32 if n < 1 << 31 else np.int64
    octets = np.ascontiguousarray(prints.astype(">u8")).view(np.uint8).reshape(n, -1)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).astype(small)
    # nodes by level: begin, end, bits since the level above, and the first child of each node of the level above
    tree = [(edge, np.append(edge[1:], small(n)), None, None)]
    for above in (skip, *range(skip // 8 * 8 + 8, BITS, 8)):
        begin = tree[-1][0]
        if len(begin) == n:
            break
        value = octets[:, above // 8] & np.uint8(255 >> above % 8)
        new = np.zeros(n, bool)
        new[begin] = True
        new[1:] |= value[1:] != value[:-1]
        child = np.flatnonzero(new).astype(small)
        tree.append((child, np.append(child[1:], small(n)), value[child], np.searchsorted(child, np.append(begin, small(n))).astype(small)))
    last = len(tree) - 1
    words = [np.ascontiguousarray(prints[:, i]) for i in range(WORDS)]
    labels: dict = {}
    seen = {} if seen is None else seen

    def count(what: str, x) -> None:
        seen[what] = seen.get(what, 0) + int(x)

    def apart(lv, a, b):
        """Which node pairs aren't in one component as a whole."""
        if labels.get(lv, (-1,))[0] != joined.turn:
            labels[lv] = joined.turn, np.minimum.reduceat(joined.label, tree[lv][0]), np.maximum.reduceat(joined.label, tree[lv][0])
        _, low, high = labels[lv]
        return (low[a] != high[b]) | (low[b] != high[a])

    def pairs(lv, a, b, err):
        """Children of node pairs (below the last level: rows), in blocks of about ``most``."""
        kids = tree[lv][0] if lv == last else tree[lv + 1][3]
        stop = tree[lv][1] if lv == last else kids[1:]
        na, nb = (stop[a] - kids[a]).astype(np.int64), (stop[b] - kids[b]).astype(np.int64)
        times = na * nb
        if len(a) == 1 and times[0] > most:  # one huge pair: some children of the left at a time
            right = np.arange(kids[b[0]], stop[b[0]])
            some = max(1, most // len(right))
            for lo in range(int(kids[a[0]]), int(stop[a[0]]), some):
                left = np.repeat(np.arange(lo, min(lo + some, int(stop[a[0]]))), len(right))
                yield left, np.tile(right, len(left) // len(right)), np.repeat(err, len(left)), np.repeat(a == b, len(left))
            return
        inner, wide = _ranges(np.zeros(len(a), np.int64), times), np.repeat(nb, times)
        yield np.repeat(kids[a], times) + inner // wide, np.repeat(kids[b], times) + inner % wide, np.repeat(err, times), np.repeat(a == b, times)

    roots = np.arange(len(edge), dtype=small)
    stack = [(0, roots, roots, np.zeros(len(edge), np.int16))]
    while stack:
        lv, a, b, err = stack.pop()
        if joined is not None and joined.turn:
            ok = apart(lv, a, b)
            a, b, err = a[ok], b[ok], err[ok]
            if not len(a):
                continue
        kids = tree[lv][0] if lv == last else tree[lv + 1][3]
        stop = tree[lv][1] if lv == last else kids[1:]
        if len(a) > 1 and int(((stop[a] - kids[a]).astype(np.int64) * (stop[b] - kids[b])).sum()) > most:
            half = len(a) // 2
            stack += [(lv, a[:half], b[:half], err[:half]), (lv, a[half:], b[half:], err[half:])]
            continue
        for left, right, e, equal in pairs(lv, a, b, err):
            ok = ~equal | ((left < right) if lv == last else (left <= right))
            left, right, e = left[ok], right[ok], e[ok]
            if lv < last:
                chunk, begin, end = tree[lv + 1][2], tree[lv + 1][0], tree[lv + 1][1]
                e = e + np.bitwise_count(chunk[left] ^ chunk[right])
                ok = e <= budget
                count("met", len(ok))
                count("pruned", len(ok) - ok.sum())
                left, right, e = left[ok], right[ok], e[ok]
                lone = (end[left] - begin[left] == 1) & (end[right] - begin[right] == 1)
                down = ~lone
                if down.any():
                    stack.append((lv + 1, left[down].astype(small), right[down].astype(small), e[down].astype(np.int16)))
                lone &= left != right
                left, right = begin[left[lone]], begin[right[lone]]
                count("leaves", len(left))
                e = np.zeros(len(left), np.int32)
                for w in words:
                    e = e + np.bitwise_count(w[left] ^ w[right])
                    ok = e <= budget
                    left, right, e = left[ok], right[ok], e[ok]
                count("leaves pruned", lone.sum() - len(left))
            if len(left):
                yield left, right, e


def _joined(w: int, tables: int, budget: int, block: int = 1 << 16):
    """Sorted rows to edges (member, smallest member of its component in the subtrie)."""

    def solve(held):
        key = np.concatenate([k for k, _, _ in held])
        ids = np.concatenate([i for _, i, _ in held])
        prints = np.concatenate([p for _, _, p in held])
        shared = np.concatenate([[False], key[1:] == key[:-1]])
        shared[:-1] |= shared[1:]
        key, ids, prints = key[shared], ids[shared], prints[shared]
        if not len(key):
            return
        order = np.lexsort((*(prints[:, i] for i in reversed(range(WORDS))), key))
        key, ids, prints = key[order], ids[order], prints[order]
        joined = Components(len(ids))
        for left, right, _ in trie_join(prints, key, w, budget, joined=joined):
            joined.join(left, right)
        if joined.turn:
            root = joined.label
            low = ids.copy()
            np.minimum.at(low, root, ids)
            low = low[root]
            moved = np.flatnonzero(low != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(low[moved])], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.stack([batch.column(i + 2).to_numpy().view(np.uint64) for i in range(WORDS)], axis=1)
            key = batch.column(0).to_numpy()
            if rows >= block:  # up to the last whole subtrie
                new = np.flatnonzero(key != held[-1][0][-1])
                if len(new):
                    cut = int(new[0])
                    held.append((key[:cut], batch.column(1).to_numpy()[:cut], prints[:cut]))
                    yield from solve(held)
                    held, rows = [(key[cut:], batch.column(1).to_numpy()[cut:], prints[cut:])], len(key) - cut
                    continue
            held.append((key, batch.column(1).to_numpy(), prints))
            rows += len(key)
        if held:
            yield from solve(held)

    return run


def connected(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(a, b) edges with b < a to (doc_id, kept_doc_id): every member but the smallest, with the smallest.

    Alternating large-star and small-star steps: each shuffles narrow rows, and their number grows with the
    logarithm of the longest chain. Every step is written to the shared folder.
    """
    now, turn = scratch.table(edges.distinct(), f"{name}0"), 0
    while True:
        shape = now.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
        chained = now.select(F.col("b").alias("a")).distinct().join(now, "a", "left_semi")
        if shape.n == shape.d and chained.isEmpty():
            return now.select(F.col("a").alias("doc_id"), F.col("b").alias("kept_doc_id"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        turn += 1
        now = scratch.table(small.distinct(), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")


def near_duplicates(spark: SparkSession, docs: DataFrame, budget: int = BUDGET, differ: float | None = None, miss: float = MISS) -> DataFrame:
    """(doc_id, kept_doc_id) of each document that goes and the one of its group that stays."""
    scratch = Scratch(spark)
    prints = scratch.table(sign(docs), "prints")
    exact = scratch.table(prints.groupBy(*_COLUMNS).agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "exact")
    w, tables = layout(exact.count(), budget / BITS if differ is None else differ, miss)
    spread = exact.select(F.col("low").alias("doc_id"), *_COLUMNS).mapInArrow(_spread(w, tables), "key long, doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS))
    pairs = spread.repartition("key").sortWithinPartitions("key").mapInArrow(_joined(w, tables, budget), "a long, b long")
    copies = prints.join(exact.where("n > 1"), _COLUMNS).where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    out = connected(scratch, pairs.union(copies))
    scratch.drop("exact")
    scratch.drop("prints")
    return out


def keep_one(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` names."""
    return drop_ids(docs, near_duplicates(spark, docs, **how))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"))
