import json

import pytest
from pyspark.sql import functions as F

from braidwell.operators import documents as D
from braidwell.operators import fusion as U
from braidwell.plans import packs as K
from braidwell.schema import CANDIDATE, SOURCE, conform

DOCS = [(1, "ranking", "fusion ranks lists of evidence by reciprocal rank"), (2, "lineage", "lineage follows derived evidence to its root"), (3, "budget", "a token budget bounds the answer"), (4, "old ranking", "ranks lists of evidence the old way")]
CASES = [{"schema_version": 1, "case_id": "c1", "tags": ["t"], "expected_behavior": "answer", "query": "how does lineage follow the root"}, {"schema_version": 1, "case_id": "c2", "tags": ["t", "none"], "expected_behavior": "abstain", "query": "unknown zebra"}, {"schema_version": 1, "case_id": "c3", "query": "rank evidence lists", "expected_behavior": "answer"}]
JUDGMENTS = [{"case_id": "c1", "lineage_root": "u:2", "relevance": 3, "required": True}, {"case_id": "c3", "lineage_root": "u:1", "relevance": 3, "required": True}, {"case_id": "c3", "lineage_root": "u:4", "relevance": 0, "forbidden": True}]


def save(folder, cases=CASES, judgments=JUDGMENTS):
    (folder / "pack.json").write_text(json.dumps({"schema_version": 1, "thresholds": {"abstention_accuracy": 1.0}}))
    for name, rows in (("cases", cases), ("judgments", judgments)):
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(folder)


def test_run(spark, tmp_path):
    pack = K.load(save(tmp_path))
    docs = spark.createDataFrame(DOCS, "chunk_id long, title string, text string").withColumn("record_id", F.col("chunk_id"))
    sources = conform(spark.createDataFrame([("u", "docs", 1.0)], "source_uid string, source_id string, base_prior double"), SOURCE)

    def search(queries):
        found = D.candidates(D.search(D.build_index(docs), queries), docs, "u", "docs")
        return U.fuse(conform(found, CANDIDATE), sources, queries)

    chunks = docs.where("chunk_id <> 4").select(F.lit("u").alias("source_uid"), F.col("chunk_id").cast("string").alias("local"), "title", "text", F.concat(F.lit("d#L"), F.lit(1)).alias("locator"))
    scores, gates = K.run(spark, pack, search, chunks)
    by = {r.case_id: r for r in scores.collect()}
    assert by["c1"].mrr_at_10 == 1.0 and by["c1"].ndcg_at_10 == 1.0 and by["c1"].required_at_5 == 1.0
    assert by["c2"].abstention_accuracy == 1.0 and by["c2"].ndcg_at_10 is None
    assert by["c1"].locator_success == 1.0 and by["c2"].locator_success is None and 0 < by["c3"].locator_success < 1  # one document is gone
    assert by["c3"].required_at_5 == 1.0 and by["c3"].forbidden_at_5 == 1.0
    status = {r.gate: r.status for r in gates.collect()}
    assert status["abstention"] == "pass" and status["forbidden"] == "fail"
    K.write(scores, gates, {"run": 1}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "cases")).count() == 3


def test_candidates_carry_the_lines_that_match(spark):
    docs = spark.createDataFrame([(1, "long", "intro words here\n" * 40 + "the needle stands here\nend"), (2, "short", "nothing of it")], "chunk_id long, title string, text string").withColumn("record_id", F.col("chunk_id"))
    queries = spark.createDataFrame([(1, "where is the needle"), (2, "nothing")], "query_id long, query string")
    found = D.search(D.build_index(docs), queries)
    got = {(r.query_id, r.local): (r.excerpt_kind, r.excerpt) for r in D.candidates(found, docs, "u", "docs", D.query_terms(queries)).collect()}
    assert got[1, "1"][0] == "matched" and "needle" in got[1, "1"][1] and got[2, "2"][0] == "matched"
    assert {r.excerpt_kind for r in D.candidates(found, docs, "u", "docs").collect()} == {"preview"}


def test_every_problem_is_told_at_once(tmp_path):
    bad = save(tmp_path, [{"case_id": "a", "query": "", "colour": 1}, {"case_id": "a", "query": "x", "expected_behavior": "dance"}], [{"case_id": "z", "lineage_root": "nocolon", "relevance": 9, "required": True, "forbidden": True}])
    with pytest.raises(ValueError, match="unknown key colour.*query is required.*unknown expected_behavior dance.*named twice.*no case z.*uid:local.*0 to 3.*both required and forbidden"):
        K.load(bad)
