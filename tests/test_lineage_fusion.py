import itertools
import random

import pytest
from pyspark.sql import functions as F

from braidwell.operators import fusion as U
from braidwell.operators import lineage as L
from braidwell.schema import CANDIDATE, QUERY, SOURCE, conform


def brute_root(node, parents, pool):
    root, path, at, depth = node, [node], node, 0
    for step in itertools.count(1):
        up = sorted(parents.get(at, ())) if at in pool else []
        if not up:
            return root, depth, None, []
        if len(up) > 1:
            return root, depth, None, up
        if up[0] in path:
            return min([*path, up[0]]), depth, "cycle", []
        if step > L.MAX_DEPTH:
            return root, depth, "max_depth", []
        root = at = up[0]
        path.append(root)
        depth = step


def test_roots_equal_a_walk(spark):
    r = random.Random(0)
    nodes = [f"s:{i:02}" for i in range(60)]
    parents = {}
    for n in nodes:
        for _ in range(r.choice([0, 1, 1, 1, 1, 2])):
            parents.setdefault(n, set()).add(r.choice(nodes + ["gone:1"]))
    edges = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child string, parent string")
    got = {x.node: (x.root, x.depth, x.reason, list(x.ancestors)) for x in L.roots(spark.createDataFrame([(n,) for n in nodes], "node string"), edges).collect()}
    assert got == {n: brute_root(n, parents, set(nodes)) for n in nodes}


def test_locators(spark):
    src = spark.createDataFrame([("u1", "mail"), ("u2", "docs")], "source_uid string, source_id string")
    rows = L.resolve(spark.createDataFrame([("docs:a:b#L1",), ("u1:x",), ("none:x",), ("nocolon",), (":x",)], "locator string"), src).collect()
    assert {x.locator: (x.root, x.reason) for x in rows} == {"docs:a:b#L1": ("u2:a:b#L1", None), "u1:x": ("u1:x", None), "none:x": (None, "source_not_configured"), "nocolon": (None, "source_not_configured"), ":x": (None, "source_not_configured")}


def lin(root, ancestors=(), up=None, depth=0):
    return {"root": root, "depth": depth, "ancestors": list(ancestors), "source_derives_from": up}


def test_independence():
    assert L.independent([lin("a:1"), lin("a:1"), lin("b:1")]) == 2
    assert L.independent([lin("a:1"), lin("c:1", ["a:1", "b:1"])]) == 1
    assert L.independent([lin("c:1", ["a:1", "b:1"])]) == 1
    assert L.independent([lin("a:1"), lin("b:9", up="a")]) == 1
    assert L.independent([lin("b:9", up="a")]) == 1
    assert L.derivation_cycles({"a": "b", "b": "a", "c": "a", "d": "e"}) == [["a", "b"]]


SOURCES = [("u1", "one", 1.0, {"natural_language": 1.5}, None, None), ("u2", "two", 1.0, None, None, "loc"), ("u3", "three", 1.0, None, "one", "loc")]


def run(spark, rows, floor=0.1, query=None, limit=20, per_source=0):
    names = ["query_id", "source_uid", "source_id", "local", "local_rank", "relevance", "record_type", "source_record_id", "content_fingerprint", "title", "match_signals", "derived_from", "excerpt_kind", "source_revision"]
    kinds = "query_id long, source_uid string, source_id string, local string, local_rank int, relevance double, record_type string, source_record_id string, content_fingerprint string, title string, match_signals array<string>, derived_from array<string>, excerpt_kind string, source_revision string"
    full = [tuple({"query_id": 1, "source_id": {"u1": "one", "u2": "two", "u3": "three"}[x["source_uid"]], "record_type": "document", "match_signals": ["lexical"], "derived_from": [], **x}.get(n) for n in names) for x in rows]
    c = conform(spark.createDataFrame(full, kinds).withColumn("candidate_id", F.concat_ws("/", "source_uid", "local")), CANDIDATE)
    s = conform(spark.createDataFrame(SOURCES, "source_uid string, source_id string, base_prior double, intent_priors map<string,double>, derives_from string, location string"), SOURCE)
    q = conform(spark.createDataFrame([(1, *(query or ("natural_language", [], None, [])))], "query_id long, query_class string, stable_identifiers array<string>, mode string, suppress_lineages array<string>"), QUERY)
    results, ledger = U.fuse(c, s, q, floor, 2.0, limit, per_source)
    return results.orderBy("position").collect(), ledger.orderBy("reason", "lineage_root").collect()


def c(uid, local, rank, rel=1.0, **more):
    return {"source_uid": uid, "local": local, "local_rank": rank, "relevance": rel, **more}


def test_priors_relevance_and_order(spark):
    got, _ = run(spark, [c("u1", "a", 1, 0.5), c("u2", "b", 1, None), c("u2", "d", 2, 7.0), c("u2", "e", 3, float("nan")), c("u2", "f", 4, -1.0)])
    assert [(r.local, round(r.score, 9)) for r in got] == [("b", round(1 / 61, 9)), ("d", round(1 / 62, 9)), ("a", round(1.5 * 0.5 / 61, 9)), ("e", 0.0)]


def test_same_record_is_one_unit_and_copies_corroborate_once(spark):
    got, _ = run(spark, [c("u1", "a#1", 1, source_record_id="a"), c("u1", "a#2", 2, source_record_id="a"), c("u2", "x", 1, content_fingerprint="f", title="Some Name"), c("u1", "y", 3, content_fingerprint="f", title="some name")])
    by = {tuple(r.members): r for r in got}
    assert by[("u1:a#1", "u1:a#2")].independent_units == 1  # two sections of one record
    assert by[("u1:a#1", "u1:a#2")].score == pytest.approx(1.5 / 61)
    assert by[("u1:y", "u2:x")].score == pytest.approx(max(1 / 61, 1.5 / 63))


def test_one_unit_counts_each_lineage(spark):
    got, _ = run(spark, [c("u1", "a", 1, title="Ada Lovelace"), c("u2", "b", 1, title="ada lovelace!"), c("u2", "d", 2, title="Ada  Lovelace")])
    assert len(got) == 1 and got[0].independent_units == 3 and got[0].cap_applied
    assert got[0].score == pytest.approx(2 * 1.5 / 61) or got[0].score == pytest.approx(1.5 / 61 + 1 / 61 + 1 / 62)


def test_derived_evidence_does_not_corroborate(spark):
    got, _ = run(spark, [c("u1", "a", 1, title="Ada Lovelace"), c("u2", "b", 1, title="Ada Lovelace", derived_from=["one:a", "one:z"])])
    assert len(got) == 1 and got[0].independent_units == 1 and got[0].score == pytest.approx(1.5 / 61)
    got, _ = run(spark, [c("u1", "a", 1), c("u2", "b", 1, derived_from=["one:a"])])
    assert len(got) == 1 and got[0].lineage_root == "u1:a"  # one lineage
    got, _ = run(spark, [c("u1", "a", 1, title="Ada Lovelace"), c("u3", "b", 1, title="Ada Lovelace")])
    assert got[0].independent_units == 1  # its source derives from the other one


def test_exact_promotion(spark):
    rows = [c("u1", "a", 1), c("u2", "ab-12", 9, 0.01, match_signals=["exact_identifier"], title="AB-12")]
    assert run(spark, rows, query=("identifier_query", ["ab-12"], None, []))[0][0].local == "ab-12"
    assert run(spark, rows, query=("identifier_query", ["zz-99"], None, []))[0][0].local == "a"
    assert run(spark, rows)[0][0].local == "a"
    alias = [rows[0], {**rows[1], "match_signals": ["exact_identifier", "alias"]}]
    assert run(spark, alias)[0][0].local == "ab-12"


def test_floor_suppression_duplicates_and_limit(spark):
    rows = [c("u1", "a", 1, content_fingerprint="p"), c("u1", "b", 2, content_fingerprint="p", record_type="message"), c("u1", "d", 3, 0.05), c("u2", "e", 1)]
    got, ledger = run(spark, rows)
    assert [r.local for r in got] == ["a", "e"]
    assert [(x.reason, x.lineage_root) for x in ledger] == [("duplicate", "u1:b"), ("relevance_floor", "u1:d")]
    got, ledger = run(spark, [c("u1", "d", 3, 0.05)])
    assert [r.local for r in got] == ["d"] and not ledger  # the floor stands down
    got, ledger = run(spark, rows, query=("natural_language", [], "pre_reply", ["u1:a"]))
    assert ("lineage_seen", "u1:a") in [(x.reason, x.lineage_root) for x in ledger] and [r.local for r in got][0] in ("b", "e")
    assert len(run(spark, [c("u1", f"x{i}", i) for i in range(1, 30)])[0]) == 20
    got, ledger = run(spark, [c("u1", f"x{i}", i) for i in range(1, 6)] + [c("u2", "y", 1, 0.2)], limit=3, per_source=2)
    assert [r.local for r in got] == ["x1", "x2", "y"] and [x.reason for x in ledger] == ["diversity"] * 3


def test_views_fold(spark):
    same = dict(source_record_id="r", content_fingerprint="p", source_revision="v")
    got, ledger = run(spark, [c("u1", "a", 1, **same), c("u2", "b", 1, **same)])
    assert len(got) == 1 and got[0].lineage_root == "u1:a"
    assert [(x.reason, x.lineage_root, x.fused_into) for x in ledger] == [("duplicate_view", "u2:b", "u1:a")]


def test_preview_gives_way_to_a_match_of_the_same_record(spark):
    got, _ = run(spark, [c("u1", "a#1", 1, source_record_id="a", excerpt_kind="preview"), c("u1", "a#2", 5, source_record_id="a", excerpt_kind="matched")])
    assert got[0].local == "a#2" and got[0].score == pytest.approx(1.5 / 61)


def test_order_of_arrival_does_not_matter(spark):
    r = random.Random(4)
    rows = [c(f"u{r.randint(1, 2)}", f"n{i}", i + 1, r.choice([None, 0.0, 0.5, 1.0]), title=r.choice(["Ada Lovelace", "Alan Turing", "x"]), content_fingerprint=r.choice([None, "p", "q"]), source_record_id=f"r{r.randint(0, 9)}") for i in range(25)]
    one = [tuple(x) for x in run(spark, rows)[0]]
    for _ in range(2):
        r.shuffle(rows)
        assert [tuple(x) for x in run(spark, rows)[0]] == one


def test_bad_candidates_fail(spark):
    with pytest.raises(Exception, match="bad candidate"):
        run(spark, [c("u1", "a", 0)])
    assert run(spark, [c("u1", "a", 1)])[0]


def test_components(spark):
    from braidwell.shared import shared_dir

    shared_dir(spark)
    links = spark.createDataFrame([(i, f"k{i // 2}") for i in range(40)] + [(i, f"j{(i + 1) // 2}") for i in range(39)] + [(100, "z"), (101, "z"), (200, "y")], "node long, key string")
    got = {x.node: x.component for x in U.components(links).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 100, 101: 100, 200: 200}


def test_nodes_that_share_a_hub_or_have_stopped_stay_spread(spark):
    """With shuffled joins no task gets all nodes, though they lead to one hub in three steps and have all stopped then."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # the hubs are less, all nodes more
    try:
        leaves = spark.range(20000).select(F.concat(F.lit("a:"), "id").alias("child"), F.concat(F.lit("b:"), F.col("id") % 10).alias("parent"))
        edges = leaves.union(spark.range(10).select(F.concat(F.lit("b:"), "id"), F.lit("c:0"))).union(spark.createDataFrame([("c:0", "d:0")], leaves.schema))
        walk = L.roots(edges.select(F.col("child").alias("node")), edges).withColumn("at", F.spark_partition_id())
        tasks = walk.groupBy("at").agg(F.count("*").alias("n"), F.min("root").alias("root"), F.max("root").alias("last"), F.max("depth").alias("depth")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(t.n for t in tasks) == 20011 and max(t.n for t in tasks) < 10000
    assert {(t.root, t.last, t.depth) for t in tasks} == {("d:0", "d:0", 3)}


def test_batches_are_cut_between_queries():
    import pyarrow as pa

    r = random.Random(3)
    for _ in range(30):
        ids = sorted(r.choices(range(9), k=r.randint(0, 40)))
        rows, batches = list(ids), []
        while rows:
            n = r.randint(0, 7)
            batches.append(pa.RecordBatch.from_pydict({"query_id": pa.array(rows[:n], pa.int64())}))
            rows = rows[n:]
        got = [t.column("query_id").to_pylist() for t in U.whole_queries(iter(batches))]
        assert sum(got, []) == ids and sum(len(set(x)) for x in got) == len(set(ids))
