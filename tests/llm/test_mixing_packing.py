import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from braidwell.llm import mixing, packing
from braidwell.llm.tokens import encode, encoder, parts
from tests.llm.cases import AWKWARD, awkward_documents


def best_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    return max(sums)


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 120))
def test_fullest_equals_brute_force(counts, room):
    used = packing.fullest(sorted(counts, reverse=True), counts, room)
    assert all(used[n] <= counts[n] for n in used)
    assert sum(n * k for n, k in used.items()) == best_sum(counts, room)


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=8), st.integers(0, 2000))
def test_fit_reaches_the_best_sum_that_its_share_of_each_length_leaves(counts, budget):
    take = mixing.fit(counts, budget)
    total = sum(n * c for n, c in counts.items())
    got = sum(n * k for n, k in take.items())
    assert all(0 <= take[n] <= counts[n] for n in take) and got <= budget
    if total <= budget:
        assert take == counts
    else:
        floor = {n: c * budget // total for n, c in counts.items()}
        left = budget - sum(n * k for n, k in floor.items())
        assert got - (budget - left) == best_sum({n: counts[n] - floor[n] for n in counts}, left)


def test_budgets():
    assert mixing.budgets({"a": 100, "b": 10}, 60, {"a": 1, "b": 1}) == {"a": 50, "b": 10}
    assert mixing.budgets({"a": 100, "b": 50}, 60, {"a": 2, "b": 1}) == {"a": 40, "b": 20}
    assert mixing.budgets({"a": 100, "b": 50}, 60, {"a": 1}) == {"a": 60}
    assert mixing.budgets({}, 0) == {}


def test_patterns_use_everything_once():
    r = random.Random(1)
    counts = Counter(r.randint(1, 300) for _ in range(800))
    used = Counter()
    for combo, times in packing.patterns(counts, 300):
        assert sum(n * k for n, k in combo) <= 300
        used.update({n: k * times for n, k in combo})
    assert used == counts


def test_packing_covers_each_token_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(spark, docs, capacity=512, shard_tokens=20_000).collect()
    size, cover, bins = {d.doc_id: len(encode(d.text)) for d in docs.collect()}, {}, {}
    for r in rows:
        cover.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        bins.setdefault(r.bin_id, []).append((r.position, r.bin_offset, r.n_tokens))
    for d, pieces in cover.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == size[d]
    assert set(cover) == {d for d, n in size.items() if n}
    for pieces in bins.values():
        at = 0
        for k, (position, offset, n) in enumerate(sorted(pieces)):
            assert position == k and offset == at
            at += n
        assert at <= 512
    assert len(bins) <= sum(size.values()) // 512 + 1 + 10  # at most one bin in each of ten shards is far from full


def test_ids_stay_as_they_are_beside_null_ids(spark):
    ids = [9007199254740993, 9007199254740995, None, None, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    assert Counter(r.doc_id for r in packing.pack(spark, docs, capacity=8).collect() if r.token_start == 0) == Counter(ids)


def test_rows_without_ids_are_dealt_out_to_all_shards(spark):
    docs = spark.createDataFrame([(None, f"text number {k} and some more words") for k in range(400)], "doc_id long, text string")
    rows = packing.pack(spark, docs, capacity=64, shard_tokens=400).collect()
    shards = Counter(r.bin_id >> 40 for r in rows)
    assert sum(r.n_tokens for r in rows) == sum(len(encode(r.text)) for r in docs.collect()) and len(shards) > 5 and max(shards.values()) < 150


def test_selection_fits_budgets_and_is_seeded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = {r.doc_id: r for r in mixing.select(spark, docs).collect()}
    assert set(one) == {r.doc_id for r in mixing.select(spark, docs.repartition(7)).collect()}
    assert set(one) != {r.doc_id for r in mixing.select(spark, docs, seed=3).collect()}
    size = {d.doc_id: (d.source, len(encode(d.text))) for d in docs.collect()}
    tokens, got = Counter(), Counter()
    for s, n in size.values():
        tokens[s] += n
    for d, r in one.items():
        assert size[d] == (r.source, r.n_tokens)
        got[r.source] += r.n_tokens
    goal = mixing.budgets(tokens, int(sum(tokens.values()) * 0.9))
    assert all(got[s] <= goal[s] and got[s] >= goal[s] - 30 for s in goal)
    out = mixing.mixed(spark, docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(one)


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    everything = mixing.mixed(spark, docs, fraction=1.0)
    assert everything.columns == docs.columns
    assert sorted(r.doc_id for r in everything.collect()) == [3, 5, 6, 7, 8, 9, 9, 10, 11]
    assert mixing.mixed(spark, docs, fraction=0.0).count() == 0
    assert mixing.select(spark, docs.limit(0)).count() == 0
    rows = packing.pack(spark, docs).collect()
    assert Counter(r.doc_id for r in rows if r.token_start == 0) == Counter(r[0] for r in AWKWARD if r[1])
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_long_texts_are_tokenised_in_parts_without_a_difference():
    text = "\n\n  Many words, ünïcode  and   gaps \t\n" * 3000
    assert len(list(parts(text, 1000))) > 5
    assert list(itertools.chain.from_iterable(encoder().encode_ordinary(p) for p in parts(text, 1000))) == encoder().encode_ordinary(text)
