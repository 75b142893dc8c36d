from collections import Counter

import corpus_pipeline
from braidwell.llm import mixing, simhash
from braidwell.llm.common import read_table
from braidwell.llm.tokens import encode
from tests.llm.cases import awkward_documents
from tests.llm.test_substring import brute as brute_spans

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]

    named = stages["language_id"](spark, docs, SMALL).cache()
    assert named.columns == docs.columns and named.count() == docs.count()  # all are prose
    gone = {r.doc_id for r in simhash.near_duplicates(spark, named).collect()}
    one = stages["near_dedup"](spark, named, SMALL).cache()
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (named, one))
    assert set(after) == set(before) - gone
    assert len(set(after.values())) == len(after)  # no exact copies are left
    cut = stages["substring_dedup"](spark, one, SMALL).cache()
    spans = brute_spans(after)
    want = {}
    for i, t in after.items():
        left, p = "", 0
        for a, b, _ in spans.get(i, []):
            left, p = left + t[p:a], b
        if left + t[p:]:
            want[i] = left + t[p:]
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == {i: t for i, t in want.items() if i in got} and all(not t.strip(" .,!?\n") for i, t in want.items() if i not in got)
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.doc_id in spans)
    mix = stages["source_mixing"](spark, cut, SMALL).cache()
    tokens, taken = Counter(), Counter()
    for r in cut.collect():
        tokens[r.source] += len(encode(r.text))
    for r in mix.collect():
        taken[r.source] += len(encode(r.text))
    goal = mixing.budgets(tokens, int(sum(tokens.values()) * 0.9))
    assert mix.columns == docs.columns and all(taken[s] <= goal[s] for s in goal) and sum(taken.values()) > 0.85 * sum(goal.values())
    packed = stages["best_fit_packing"](spark, mix, SMALL).collect()
    assert sum(r.n_tokens for r in packed) == sum(taken.values())


def test_run_equals_its_stages(spark):
    docs = read_table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(tuple, docs.collect()))


def test_awkward_rows_go_through_every_stage(spark):
    docs = awkward_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
    empty = awkward_documents(spark).limit(0)
    assert all(stage(spark, empty, SMALL).count() == 0 for _, stage in corpus_pipeline.STAGES)
