import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwell.llm import simhash as S
from braidwell.llm.common import Words, text_buffers
from tests.llm.cases import awkward_documents, sentence


def test_word_hashes_do_not_depend_on_place_or_case():
    a = Words(*text_buffers(pa.array(["Éa Hello wörld", None, "", "x hello,éa WÖRLD"]))[:2])
    h = a.hashes()
    assert list(a.doc) == [0, 0, 0, 3, 3, 3, 3]
    assert set(h[:3]) == set(h[4:])
    long = "w" * 700_000 + " b"
    b = Words(*text_buffers(pa.array([long, long]))[:2]).hashes()
    assert b[0] == b[2] and b[1] == b[3]


@pytest.mark.parametrize("budget,most", [(0, 1 << 20), (20, 1 << 20), (46, 50), (256, 1 << 20)])
def test_trie_join_equals_brute_force(budget, most):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    near = base[rng.integers(0, 40, 60)].copy()
    for row in near:
        for bit in rng.integers(8, 256, rng.integers(0, 30)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(63 - bit % 64)
    prints = np.concatenate([base, near, near[:5]])
    group = (prints[:, 0] >> np.uint64(56)).astype(np.int64)
    order = np.lexsort((*(prints[:, i] for i in (3, 2, 1, 0)), group))
    prints, group = prints[order], group[order]
    got = {(int(i), int(j), int(e)) for a, b, d in S.trie_join(prints, group, 8, budget, most=most) for i, j, e in zip(a, b, d)}
    bits = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    want = {(i, j, int(bits[i, j])) for i in range(len(prints)) for j in range(i + 1, len(prints)) if group[i] == group[j] and bits[i, j] <= budget}
    assert got == want


def test_components():
    c = S.Components(10)
    c.join(np.array([5, 3]), np.array([3, 4]))
    c.join(np.array([8, 1]), np.array([9, 8]))
    assert list(c.label) == [0, 1, 2, 3, 3, 3, 6, 7, 1, 1]
    before = c.turn
    c.join(np.array([9]), np.array([1]))
    assert c.turn == before


def clusters(sizes, flips, seed=1, shared=20):
    """Fingerprints of one subtrie: near copies of centres that have their first bits in common."""
    rng = np.random.default_rng(seed)
    top, rows = rng.integers(0, 2, shared), []
    for n in sizes:
        centre = np.concatenate([top, rng.integers(0, 2, S.BITS - shared)])
        bits = np.tile(centre.astype(np.uint8), (n, 1))
        for _ in range(flips):
            bits[np.arange(n), rng.integers(shared, S.BITS, n)] ^= 1
        rows.append(bits)
    prints = np.packbits(np.concatenate(rows), axis=1).view(">u8").astype(np.uint64)
    return np.unique(prints, axis=0)


def test_budget_prunes_node_pairs_above_the_leaves():
    prints, seen = clusters([300] * 6, 12), {}
    group = np.zeros(len(prints), np.int64)
    got = {(int(i), int(j)) for a, b, _ in S.trie_join(prints, group, 20, S.BUDGET, seen=seen) for i, j in zip(a, b)}
    bits = np.concatenate([np.bitwise_count(row ^ prints).sum(1)[None] for row in prints])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(bits <= S.BUDGET, 1)))))
    assert seen["pruned"] > 1000 and seen["leaves"] < len(prints) ** 2 / 2
    joined, some = S.Components(len(prints)), {}
    for a, b, _ in S.trie_join(prints, group, 20, S.BUDGET, joined=joined, seen=some):
        joined.join(a, b)
    want = S.Components(len(prints))
    want.join(*(np.array(x) for x in zip(*got)))
    assert (joined.label == want.label).all() and len(set(joined.label)) == 6 and some["met"] <= seen["met"]


def test_a_large_group_of_near_copies_takes_little_memory():
    import tracemalloc

    prints = clusters([30_000], 14)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prints), np.int64)), pa.array(np.arange(len(prints))), *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(S.WORDS))], names=["key", "doc_id", *S._COLUMNS])
    tracemalloc.start()
    edges = [(a, b) for out in S._joined(20, 1, S.BUDGET)([batch]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert sorted(edges) == [(i, 0) for i in range(1, len(prints))]


def test_connected_long_chain(spark):
    from braidwell.llm.common import Scratch

    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    out = {r.doc_id: r.kept_doc_id for r in S.connected(Scratch(spark), edges).collect()}
    assert out == {i: 0 for i in range(1, 60)}


def test_planted_copies_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(3)
    texts = {i: " ".join(sentence(r, 12) for _ in range(14)) for i in range(120)}
    pairs, n = {}, 1000
    for i in range(0, 60):
        words = texts[i].split()
        if i % 2:
            for at in r.sample(range(len(words)), max(1, len(words) * 3 // 100)):
                words[at] = "edit" + words[at]
        texts[n] = " ".join(words)
        pairs[n], n = i, n + 1
    for _ in range(1500):  # a large group
        texts[n] = texts[119]
        pairs[n], n = 119, n + 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.kept_doc_id for x in S.near_duplicates(spark, docs).collect()}
    assert sum(got.get(a) == b for a, b in pairs.items()) >= 0.98 * len(pairs)
    assert not set(got) & set(range(120))


def test_found_share_of_pairs_within_budget(spark):
    """Against brute force over all fingerprints of a table: at least nine tenths of the close pairs are grouped."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = S.sign(docs).toPandas()
    f = prints[["f0", "f1", "f2", "f3"]].to_numpy().view(np.uint64)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    i, j = np.nonzero(np.triu(d <= S.BUDGET, 1))
    group = {r.doc_id: r.kept_doc_id for r in S.near_duplicates(spark, docs).collect()}
    ids = prints.doc_id.tolist()
    same = [group.get(ids[a], ids[a]) == group.get(ids[b], ids[b]) for a, b in zip(i, j)]
    assert len(same) and np.mean(same) >= 0.9


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    kept = S.keep_one(spark, docs)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in S.near_duplicates(spark, docs).collect()}
    assert gone == {7, 8}
    assert kept.count() == docs.count() - 2
    assert S.keep_one(spark, docs.limit(0)).count() == 0


def test_near_copies_in_scripts_without_spaces(spark):
    r = random.Random(8)
    texts = {}
    for i, (low, n) in enumerate([(0x4E00, 2000), (0x3041, 80), (0x0E01, 46)] * 5):
        letters = [chr(low + r.randrange(n)) for _ in range(400)]
        texts[i] = "".join(letters)
        letters[200] = chr(low + r.randrange(n))
        texts[100 + i] = "".join(letters)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.kept_doc_id for x in S.near_duplicates(spark, docs).collect()}
    assert all(got.get(100 + i) is not None for i in range(15))
    assert not {i for i in range(0, 15, 3)} & set(got)


@pytest.mark.parametrize("count", [1_000, 15_000_000, 10**8])
def test_pairs_at_the_budget_are_met_at_every_corpus_size(count):
    """Pairs of fingerprints that differ in exactly the budget's bits, cut as a corpus of ``count`` is; 1.5e7 is about 30 GB."""
    rng, n = np.random.default_rng(6), 300
    bits = rng.integers(0, 2, (n, S.BITS), dtype=np.uint8)
    near = bits.copy()
    for row in near:
        row[rng.choice(S.BITS, S.BUDGET, replace=False)] ^= 1
    prints = np.packbits(np.concatenate([bits, near]), axis=1).view(np.uint64)
    w, tables = S.layout(count)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n)), *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(S.WORDS))], names=["doc_id", *S._COLUMNS])
    rows = pa.Table.from_batches(list(S._spread(w, tables)([batch]))).sort_by("key").combine_chunks().to_batches()
    met = {(a, b) for out in S._joined(w, tables, S.BUDGET)(rows) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert sum((n + i, i) in met for i in range(n)) >= 0.94 * n
