from datetime import datetime

import pytest
from pyspark.sql import functions as F

from braidwell.operators import documents as D
from braidwell.operators import expand as E
from braidwell.operators import records as R
from braidwell.plans import evaluate as V
from braidwell.plans import planning as P
from braidwell.plans import shape as H


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def pairs(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


# documents


@pytest.fixture(scope="module")
def index(spark):
    return D.build_index(df(spark, "chunk_id long, text string", (1, "alpha beta gamma"), (2, "alpha alpha delta plans"), (3, "the of and is"), (4, None), (5, "box boxes beta")))


def search(spark, index, text, **how):
    return {r.chunk_id: r for r in D.search(index, df(spark, "query_id long, query string", (1, text)), **how).collect()}


def test_bm25_by_hand(spark, index):
    from math import log

    got = search(spark, index, "alpha")
    avg = (3 + 4 + 4 + 0 + 3) / 5
    want = lambda tf, n: log(1 + (5 - 2 + 0.5) / 2.5) * tf / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    assert got[1].bm25 == pytest.approx(want(1, 3), abs=1e-6) and got[2].bm25 == pytest.approx(want(2, 4), abs=1e-6)
    assert [got[2].rank, got[1].rank] == [1, 2]


def test_coverage_gate_and_question_form(spark, index):
    assert set(search(spark, index, "alpha beta")) == {1, 2, 5}
    assert set(search(spark, index, "what is the alpha beta")) == {1}  # two content terms are required of a question
    asked, bare = search(spark, index, "what is alpha"), search(spark, index, "alpha")
    assert set(asked) == set(bare)
    assert search(spark, index, "is the") and search(spark, index, "zzz is the") == {}


def test_variants_only_for_absent_terms(spark, index):
    assert set(search(spark, index, "plan")) == {2} and set(search(spark, index, "box")) == {5}
    assert search(spark, index, "plan")[2].bm25 < search(spark, index, "plans")[2].bm25


def test_filter_keeps_corpus_counts(spark, index):
    allowed = df(spark, "chunk_id long", (1,))
    assert search(spark, index, "alpha", allowed=allowed)[1].bm25 == search(spark, index, "alpha")[1].bm25


def test_quoted_text_is_discounted(spark, index):
    cited = df(spark, "chunk_id long, term string, tf long", (1, "alpha", 1), (1, "beta", 1), (1, "gamma", 1), (2, "alpha", 1))
    got = search(spark, index, "alpha", cited=cited)
    assert got[1].relevance == 0.0 and got[2].relevance == pytest.approx((1 / 3) / (1 / 3 + 0.02), abs=1e-6)


def test_exact_identifiers_lead(spark, index):
    idents = df(spark, "chunk_id long, ident string, alias boolean", (3, "plans q3", False), (5, "q3 plans", True))
    q = df(spark, "query_id long, query string", (1, "open the q3-plans alpha"))
    exact = D.identifier_matches(q, idents)
    assert pairs(exact, "chunk_id", "alias") == [(5, True)]
    assert [r.chunk_id for r in D.local_order(D.search(index, q), exact).orderBy("rank").collect()][0] == 5


def test_filters(spark, index):
    docs = df(spark, "chunk_id long, mod_time timestamp, project string", (1, datetime(2024, 1, 1), "A"), (2, datetime(2024, 1, 2), "b"), (3, None, None))
    assert pairs(D.document_filter(docs, since=datetime(2024, 1, 2)), "chunk_id") == [(2,)]
    assert pairs(D.document_filter(docs, as_of=datetime(2024, 1, 1), project="a"), "chunk_id") == [(1,)]
    assert pairs(D.entity_filter(index, ["Alpha Beta"]), "chunk_id") == [(1,)]


# records


def test_stream_weights_and_browse(spark):
    r = df(spark, "id string, title string, meta string, text string, at timestamp", ("e1", "deploy failed", "ops", "deploy api", datetime(2024, 1, 1)), ("e2", "note", "deploy", "x", datetime(2024, 1, 2)), ("v1/e3", "z", None, None, datetime(2024, 1, 3)))
    fields = {"title": (F.col("title"), 1.0), "metadata": (F.col("meta"), 0.5), "text": (F.col("text"), 0.4)}
    q = df(spark, "query_id long, query string", (1, "deploy api"), (2, ""), (3, "v1/e3 deploys"))
    got = R.search_fields(r, q, "id", fields, [F.col("id")], "at").collect()
    by = {(x.query_id, x.id): (x.score, x.exact, x.rank) for x in got}
    assert by[1, "e1"] == (0.7, False, 1) and by[1, "e2"] == (0.25, False, 2)
    assert [x.id for x in sorted(got, key=lambda x: x.rank) if x.query_id == 2] == ["v1/e3", "e2", "e1"]
    assert by[3, "v1/e3"] == (0.0, True, 1) and by[3, "e1"][0] == 0.25


def test_tasks(spark):
    t = df(spark, "id string, title string, fields string, state string, at timestamp, priority string", ("00000001", "Write report", "todo home", "TODO", None, "B"), ("00000002", "Rewrite reports", "todo", "TODO", datetime(2024, 1, 1), None), ("00000003", "Write report", "done", "DONE", None, "A"), ("00000004", "Other", "report", "TODO", None, "A"))
    q = df(spark, "query_id long, query string", (1, "write the report"), (2, "(00000004) report"))
    m = R.task_match(t, q, df(spark, "id string, term string", ("00000004", "write"), ("00000001", "write")))
    assert {x.id: x.score for x in m.where("query_id = 1").collect()} == {"00000001": 2.0, "00000002": 1.2, "00000003": 0.5, "00000004": 0.9}
    order = R.task_order(m, R.exact_ids(q, "[0-9a-f]{8}").join(t.select("id"), "id", "left_semi"), t)
    assert [x.id for x in order.where("query_id = 2").orderBy("rank").collect()] == ["00000004", "00000001", "00000002", "00000003"]
    assert pairs(R.facet_exclusions(t.withColumn("tags", F.array()).withColumn("contexts", F.array(F.lit("@Home"))), states=["todo"], priorities=["a", "b"], exclude_contexts=["home"]), "id", "facet") == [("00000001", "exclude_contexts"), ("00000002", "priorities"), ("00000003", "states"), ("00000004", "exclude_contexts")]


def test_issues(spark):
    i = df(spark, "id string, title string, description string, acceptance string, status string, type string, labels array<string>, parent_id string, sessions array<string>, priority string, updated_at timestamp", ("x-1", "Fix login", "login fails", "", "open", "bug", ["Auth"], None, ["s1"], "P1", datetime(2024, 1, 1)), ("x-2", "Docs", "about login", "", "closed", "task", [], "x-1", None, "P0", datetime(2024, 1, 2)))
    assert pairs(R.issue_filter(i, labels=["auth"]), "id") == [("x-1",)] and pairs(R.issue_filter(i, entities=["X-1"]), "id") == [("x-2",)]
    assert pairs(R.issue_filter(i, statuses=["OPEN"], types=["bug"]), "id") == [("x-1",)]
    hits = df(spark, "query_id long, probe string, id string, score int, field string", (1, "a", "x-1", 5, "title"), (1, "a", "x-2", 9, "labels"), (1, "b", "x-1", 1, "labels"))
    merged = R.merge_probes(hits)
    none = df(spark, "query_id long, id string, mention int")
    assert [x.id for x in R.issue_order(merged, none, i).orderBy("rank").collect()] == ["x-1", "x-2"]
    sig = merged.select("id", R.match_signals(F.col("id") == "x-2", F.col("fields")).alias("s"))
    assert {x.id: x.s for x in sig.collect()} == {"x-1": ["lexical", "field"], "x-2": ["exact_identifier", "field"]}
    rel = {x.id: x.relevance for x in R.issue_relevance(i, df(spark, "query_id long, query string", (1, "login"))).collect()}
    assert rel["x-1"] > rel["x-2"] > 0
    assert R.scope_total(df(spark, "status string, n long", ("open", 3), ("closed", 4)), ["open"]).first().total == 3


def test_mail(spark):
    t = df(spark, "id long, sender string, subject string, labels array<string>, position int", (1, "no-reply@x.org", "Budget 2024", ["INBOX", "UNREAD"], 1), (2, "ann@x.org", "Re: the budget", ["INBOX", "UNREAD"], 2), (3, "bob@x.org", "Lunch", ["SENT"], 3))
    rel = {x.id: x.covered for x in R.header_relevance(t, df(spark, "query_id long, query string", (1, "the budget ann"))).collect()}
    assert rel == {1: 1, 2: 2}
    flags = R.mail_flags(F.col("labels"), F.col("sender"))
    assert pairs(t.select("id", flags["needs_reply_hint"].alias("f")), "id", "f") == [(1, False), (2, True), (3, False)]
    assert [x.id for x in R.promote_exact(t.withColumn("query_id", F.lit(1)), F.col("id") == 3).orderBy("rank").collect()] == [3, 1, 2]


def test_vectors(spark):
    v = df(spark, "vec_id long, embedding array<float>", (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]))
    got = R.vector_search(v, df(spark, "query_id long, vector array<float>", (1, [2.0, 0.0])))
    assert [(x.vec_id, x.relevance) for x in got.orderBy("rank").collect()] == [(1, 1.0), (2, 0.7071), (3, 0.0), (4, 0.0)]
    head = R.span_header(F.col("s"))
    row = df(spark, "s string", ("@@ -12,4 @@ (x)\nbody",)).select(head["line"].alias("l"), head["lines"].alias("n"), head["body"].alias("b")).first()
    assert tuple(row) == (12, 4, "body")


# planning


def test_outcomes(spark):
    r = df(spark, "query_id long, source_id string, outcome string, reason string", (1, "a", "success", None), (1, "b", "skipped", "disabled"), (2, "a", "failed", "x"), (2, "b", "skipped", "as_of_unsupported"), (3, "a", "skipped", "not_applicable"), (4, "a", "partial", None), (5, "a", "skipped", "out_of_scope"))
    assert dict(pairs(P.coverage(r), "query_id", "coverage")) == {1: "complete", 2: "degraded", 3: "degraded", 4: "degraded", 5: "complete"}
    got = dict(pairs(P.outcome(r, df(spark, "query_id long", (4,))), "query_id", "outcome"))
    assert got == {1: "abstained", 2: "failed", 3: "abstained", 4: "answered", 5: "abstained"}
    assert pairs(P.degraded_list(r), "query_id", "text") == [(2, "a: failed (x)"), (2, "b: skipped (as_of_unsupported)"), (4, "a: partial")]


def test_eligibility(spark):
    s = df(spark, "source_id string, handshake_ok boolean, health string, as_of_support string, types array<string>", ("a", False, "healthy", "none", []), ("b", True, "denied", "none", []), ("c", True, "healthy", "none", ["task"]), ("d", True, "healthy", "filter", ["document"]))
    got = dict(pairs(s.select("source_id", P.dynamic_reason(F.array(F.lit("document")), F.lit(datetime(2024, 1, 1)), F.lit(100)).alias("r")).na.fill("ok"), "source_id", "r"))
    assert got == {"a": "unreachable", "b": "denied", "c": "as_of_unsupported", "d": "ok"}
    assert s.where("source_id = 'd'").select(P.dynamic_reason(F.array(F.lit("document")), F.lit(None), F.lit(20)).alias("r")).first().r == "budget_exhausted"
    assert pairs(P.unsatisfiable(df(spark, "source_id string", ("a",), ("x",), ("b",)), s, df(spark, "source_id string", ("a",))), "source_id", "reason") == [("b", "out_of_profile"), ("x", "source_not_configured")]
    assert P.unsupported_filters({"since", "entities"}, {"since"}) == "filter_unsupported: entities" and P.unsupported_filters({"since"}, {"since"}) is None


def test_admission(spark):
    c = df(spark, "query_id long, source_uid string, sensitivity int, local_rank int, local string", (1, "u", 0, 1, "a"), (1, "v", 0, 0, "b"), (1, "v", 3, 1, ""), (1, "v", 3, 2, "d"))
    up = P.raised(c, df(spark, "source_uid string, sensitivity int", ("u", 2)))
    assert sorted(r.sensitivity for r in up.collect()) == [0, 2, 3, 3]
    ok, denied = P.permitted(up, 2)
    assert ok.count() == 2 and denied.first().denied == 2
    good, bad = P.stamped(c, "core", "name")
    assert pairs(good, "source_uid", "local") == [("core", "a"), ("core", "d")] and bad.first().malformed == 2


def test_requests_and_config():
    with pytest.raises(ValueError, match="query is required; limit must not be negative; unknown mode x"):
        P.Request(" ", -1, "x")
    assert P.ranking_config([{"source_uid": "u", "source_id": "a"}])["limit"] == 20
    with pytest.raises(ValueError):
        P.ranking_config([{"source_uid": "u", "source_id": "a", "base_prior": 3.0}])


# shaping and expansion


def brute_shape(costs, frame, budget):
    out, used, whole = [], frame, True
    for w, c in costs:
        if whole and (budget <= 0 or used + w <= budget):
            used += w
            out.append("whole")
            continue
        whole = False
        if used + c <= budget:
            used += c
            out.append("compressed")
        else:
            return out + [None] * (len(costs) - len(out))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shape_equals_the_greedy_loop(spark, seed):
    import random

    r = random.Random(seed)
    cases = {q: ([(r.randint(5, 40), r.randint(1, 5)) for _ in range(12)], r.randint(0, 30), r.choice([0, 20, 60, 120, 300])) for q in range(12)}
    rows = df(spark, "query_id long, position int, whole long, compressed long", *((q, i, w, c) for q, (costs, _, _) in cases.items() for i, (w, c) in enumerate(costs, 1)))
    budgets = df(spark, "query_id long, frame long, budget long", *((q, f, b) for q, (_, f, b) in cases.items()))
    got = {}
    for x in H.shape(rows, budgets).orderBy("query_id", "position").collect():
        got.setdefault(x.query_id, []).append(x.kept)
    want = {q: brute_shape(*v) for q, v in cases.items()}
    assert got == want


def test_carried_and_trimmed(spark):
    s = df(spark, "query_id long, reason string, lineage_root string, fused_into string", (1, "duplicate_view", "a", "r1"), (1, "duplicate_view", "b", "r9"), (1, "duplicate", "c", None))
    assert pairs(H.carried(s, df(spark, "query_id long, lineage_root string", (1, "r1"))), "lineage_root") == [("a",), ("c",)]
    f = df(spark, "budget long, full long, summary long, first long", (100, 120, 20, 5), (100, 50, 20, 5), (100, 98, 20, 5), (0, 500, 20, 5))
    assert [r.frame for r in H.trimmed(f).collect()] == [20, 50, 20, 500]


def test_expansion(spark):
    text = "\n".join(f"l{i}" for i in range(1, 61))
    row = df(spark, "locator string, text string", ("a/b.md#L30-L44", text))
    path, first, last = E.line_range(F.col("locator"))
    got = row.select(path.alias("p"), *(E.line_slice(F.col("text"), first, last, k).alias(k) for k in ("summary", "excerpt", "full", "context"))).first()
    assert got.p == "a/b.md" and got.summary == "l30" and len(got.excerpt.split("\n")) == 12 and len(got.full.split("\n")) == 15 and got.context.split("\n")[0] == "l10" and got.context.endswith("l60")
    e = df(spark, "id long, ts timestamp", (1, datetime(2024, 1, 1, 0, 0)), (2, datetime(2024, 1, 1, 0, 15)), (3, datetime(2024, 1, 1, 0, 15, 1)), (4, datetime(2023, 12, 31, 23, 45)))
    assert pairs(E.episodes(e.where("id = 1"), e, "id", "ts"), "id") == [(1,), (2,), (4,)]
    n = df(spark, "note_id string, ordinal int, body string", ("n", 1, "two"), ("n", 0, "one"))
    assert E.note_context(n, df(spark, "locator string", ("n#1",))).first().text == "one\n\ntwo"
    i = df(spark, "id string", ("a",), ("b",))
    got = {r.id: r for r in E.issue_context(i, df(spark, "id string, depends_on string", ("b", "a")), df(spark, "id string, path string", ("a", "f")), df(spark, "id string, at int, line string", ("a", 2, "y"), ("a", 1, "x"))).collect()}
    assert got["a"].blocks == ["b"] and got["a"].log == ["x", "y"] and got["b"].depends_on == ["a"] and got["b"].files is None


# evaluation


def test_metrics_by_hand(spark):
    from math import log2

    ranked = df(spark, "case_id string, position int, root string", ("c", 1, "x"), ("c", 2, "a"), ("c", 3, "b2"), ("c", 4, "b"), ("d", 1, "x"))
    judged = df(spark, "case_id string, root string, grade int, required boolean, forbidden boolean", ("c", "a", 3, True, False), ("c", "b", 1, True, False), ("c", "z", 2, True, False), ("d", "x", 0, False, True))
    aliases = df(spark, "case_id string, root string, fused_into string", ("c", "b2", "b"))
    r, j = V.canonical(ranked, judged, aliases)
    assert pairs(r.where("case_id = 'c'"), "position", "root") == [(1, "x"), (2, "a"), (3, "b")]
    s = {x.case_id: x for x in V.score_cases(df(spark, "case_id string, tags array<string>, expected_behavior string", ("c", ["t", "exact"], "answer"), ("d", ["t"], "abstain")), r, j, df(spark, "case_id string, behavior string", ("c", "answer"), ("d", "answer"))).collect()}
    ideal = 3 / log2(2) + 2 / log2(3) + 1 / log2(4)
    assert s["c"].ndcg_at_10 == pytest.approx((3 / log2(3) + 1 / log2(4)) / ideal, abs=1e-6)
    assert s["c"].required_at_5 == pytest.approx(2 / 3, abs=1e-6) and s["c"].mrr_at_10 == 0.5 and s["c"].success_at_5 == 1.0 and s["c"].forbidden_at_5 is None
    assert s["d"].ndcg_at_10 is None and s["d"].mrr_at_10 is None and s["d"].forbidden_at_5 == 1.0
    assert s["c"].abstention_accuracy == 1.0 and s["d"].abstention_accuracy == 0.0
    table = spark.createDataFrame([tuple(x) for x in s.values()], "case_id string, tags array<string>, expected_behavior string, ndcg_at_10 double, required_at_5 double, required_at_20 double, mrr_at_10 double, success_at_5 double, forbidden_at_5 double, behavior string, abstention_accuracy double")
    report = V.grouped_report(table, ["mrr_at_10", "abstention_accuracy"])
    assert pairs(report, "level", "group", "abstention_accuracy") == [("group", "exact", 1.0), ("group", "t", 0.5), ("overall", "overall", 0.5)]
    assert V.macro(report, ["abstention_accuracy"]).first()[0] == 0.75
    gates = dict(pairs(V.gates(table, {"abstention_accuracy": 0.4, "exact_identifier_success_at_1": 1.0}), "gate", "status"))
    assert gates["forbidden"] == "fail" and gates["abstention"] == "pass" and gates["exact_identifier"] == "fail" and gates["latency"] == "skipped" and gates["locators"] == "skipped" and len(gates) == 11


def test_comparison(spark):
    s = "group string, mrr_at_10 double, mrr_at_10_n long, forbidden_at_5 double, forbidden_at_5_n long"
    got = V.compare(df(spark, s, ("a", 0.5, 3, 0.0, 3), ("b", 0.5, 1, None, 0), ("g", 1.0, 1, 0.0, 1)), df(spark, s, ("a", 0.4, 3, 0.2, 3), ("b", 0.6, 1, None, 0)), ["group"], ["mrr_at_10", "forbidden_at_5"])
    assert {(x.group, x.metric) for x in got.where("regression").collect()} == {("a", "mrr_at_10"), ("a", "forbidden_at_5"), ("g", "mrr_at_10"), ("g", "forbidden_at_5")}
    t = "case_id string, m double"
    assert pairs(V.case_changes(df(spark, t, ("a", 1.0), ("b", None), ("c", 0.5)), df(spark, t, ("a", 1.0), ("b", 0.2), ("c", 0.4)), ["m"]), "case_id") == [("b",), ("c",)]
    p = df(spark, "x long, y string", (1, "a"), (2, "b"))
    assert V.content_hash(p, ["x", "y"]).first() == V.content_hash(p.orderBy(F.desc("x")), ["y", "x"]).first() != V.content_hash(p.where("x = 1"), ["x", "y"]).first()
    assert V.percentile(df(spark, "v double", *((float(i),) for i in range(1, 11))), "v", 95).first().v == 10.0


def test_assertions(spark):
    res = df(spark, "case_id string, position int, root string, source_uid string, excerpt string, independent_units int, record_id string, fingerprint string, bytes long, revision string, latency_ms long", ("c", 1, "r1", "u1", "Hello", 2, "d", "f", 10, "v1", 50), ("c", 2, "r2", "u1", None, 1, "d", "f", 99, "v2", 50))
    sup = df(spark, "case_id string, reason string, count int, lineage_root string", ("c", "lineage_seen", 1, "s1"), ("c", "duplicate", 1, "s2"))
    one = lambda schema, *rows: df(spark, f"case_id string, {schema}", *rows)
    a = {
        "required_sources": one("source_uid string", ("c", "u1"), ("c", "u9")), "forbidden_sources": one("source_uid string", ("c", "u1")), "expected_revisions": one("root string, want string", ("c", "r1", "v1"), ("c", "r2", "v1")),
        "suppressed_lineages": one("root string", ("c", "s1"), ("c", "s2"), ("c", "r1")), "withheld_lineages": one("root string, want string", ("c", "s2", "duplicate"), ("c", "s1", "duplicate")), "visible_lineages": one("root string", ("c", "r1"), ("c", "gone")),
        "expected_top_lineage": one("root string", ("c", "r2")), "excerpt_contains": one("root string, want string", ("c", "r1", "hell"), ("c", "r2", "x")), "min_results": one("least int", ("c", 3)), "max_results": one("most int", ("c", 2)),
        "max_corroborated_units": one("most int", ("c", 1)), "max_results_per_record": one("most int", ("c", 1)), "max_expansion_bytes": one("most long", ("c", 50)), "max_latency_ms": one("most long", ("c", 100)),
    }
    assert pairs(V.assertion_violations(a, res, sup), "assertion", "detail") == sorted([("required_sources", "u9"), ("forbidden_sources", "u1"), ("forbidden_sources", "u1")][:2] + [("expected_revisions", "r2"), ("suppressed_lineages", "r1"), ("suppressed_lineages", "s2"), ("withheld_lineages", "s1"), ("visible_lineages", "gone"), ("expected_top_lineage", "r2"), ("excerpt_contains", "x"), ("min_results", "2"), ("max_corroborated_units", "2"), ("max_results_per_record", "d"), ("max_expansion_bytes", "99")])


def test_index_for_queries_ranks_as_the_whole_index(spark):
    """The part of an index that queries read gives the same hits, and its postings are those of their terms alone."""
    chunks = df(spark, "chunk_id long, text string", (1, "the red boxes of the inn"), (2, "a box, red red"), (3, ""), (4, None), (5, "the the who"), (6, "inns and foxes"))
    q = df(spark, "query_id long, query string", (1, "the red box"), (2, "who is the"), (3, "fox"), (4, "nothing"), (5, ""))
    whole, part = D.build_index(chunks), D.index_for(chunks, q)
    columns = ["query_id", "chunk_id", "bm25", "covered", "score", "relevance", "rank"]
    found = [sorted(map(tuple, D.search(i, q).select(columns).collect())) for i in (whole, part)]
    assert found[0] == found[1] and found[0]
    assert part.stats.collect() == whole.stats.collect() and sorted(part.lengths.collect()) == sorted(whole.lengths.collect())
    assert {x.term for x in part.vocabulary.collect()} == {"the", "red", "box", "boxes", "who", "foxes"}


def test_tasks_meet_terms_on_all_cores(spark):
    """A small file of tasks is one split; every term is looked for in every task, so it is dealt out."""
    from braidwell import catalog
    from tests.conftest import SMALL

    tasks = catalog.parts_as_tasks(spark, SMALL).withColumn("at", F.spark_partition_id())
    assert tasks.select("at").distinct().count() == spark.sparkContext.defaultParallelism
