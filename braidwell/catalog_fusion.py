"""Registered queries that run the whole fusion over a pool of candidates, and the same in SQL, step by step.

One query per customer; its orders, numbered, are found by three sources. Candidates share lineages (derived from a record
of a fourth source), records, fingerprints, entities and views; relevances are null, NaN, negative and more than one; one
source derives from another; some matches are exact or by alias; some lineages were seen before.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwell.catalog import query, table, values
from braidwell.operators import fusion as U
from braidwell.schema import CANDIDATE, QUERY, SOURCE, conform

LIMIT, PER_SOURCE, FLOOR = 3, 1, 0.1

FUSION_SQL = f"""RECURSIVE o AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_custkey % 50 AS key FROM orders),
    k AS (SELECT q, 's2' AS s, key FROM o WHERE key % 2 = 0 UNION ALL SELECT q, 's3', key FROM o WHERE key % 3 = 0 UNION ALL SELECT q, 's5', key FROM o WHERE key % 5 = 1),
    c AS (SELECT *, key // 2 AS n, key // 4 AS m, row_number() OVER (PARTITION BY q, s ORDER BY key) AS rnk, count(*) OVER (PARTITION BY q, s) AS pool_size, CASE WHEN s = 's5' THEN 's5:' || key ELSE 's0:r' || key // 2 END AS root,
        CASE WHEN key % 7 = 0 THEN NULL WHEN key % 13 = 0 THEN 'NaN'::DOUBLE ELSE (key % 11) / 8.0::DOUBLE - 0.2::DOUBLE END AS relevance, CASE WHEN s = 's5' THEN 0.5 WHEN s = 's2' AND q % 3 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS prior,
        key % 11 = 0 AS exact, key % 22 = 0 AS alias, q % 2 = 0 AND key % 7 = 3 AS named FROM k),
    r AS (SELECT *, CASE WHEN relevance IS NULL THEN 1 WHEN isnan(relevance) OR relevance < 0 THEN 0 WHEN relevance > 1 THEN 1 ELSE relevance END AS eff, CASE WHEN relevance IS NULL OR isnan(relevance) OR relevance > 1 THEN 1 WHEN relevance < 0 THEN 0 ELSE relevance END AS flo,
        CASE WHEN m % 3 = 0 THEN 'p' || m % 5 ELSE 'p' || n % 5 END AS fp, CASE WHEN m % 3 = 0 THEN 'm' || m ELSE root END AS vw,
        row_number() OVER (PARTITION BY q, root, s ORDER BY rnk, key::VARCHAR) AS nth, row_number() OVER (PARTITION BY q, root ORDER BY prior DESC, rnk, key::VARCHAR, s) AS pri FROM c),
    g AS (SELECT q, root, any_value(fp) AS fp, any_value(vw) AS vw, any_value(CASE WHEN m % 5 < 4 THEN 'e' || m % 3 ELSE vw END) AS cl, max(CASE WHEN nth = 1 THEN prior * eff / (60 + rnk) END) AS score, max(flo) AS flo, count(*) AS n, bool_or(exact) AS exact, bool_or(exact AND alias) AS alias,
        bool_or(exact AND named) AS named, list(DISTINCT s || '|' || fp) AS prints, bool_or(s <> 's5' AND r.n % 2 = 0) AS seen, any_value(CASE WHEN pri = 1 THEN {{'s': s, 'key': key::VARCHAR, 'rnk': rnk, 'prior': prior, 'pool_size': pool_size}} END) AS p FROM r GROUP BY q, root),
    u AS (SELECT q, cl, fp, max(score) AS score, min(root) AS root, bool_and(root LIKE 's5:%') AS derived FROM g GROUP BY q, cl, fp),
    t AS (SELECT q, cl, list_reduce(coalesce(list(score ORDER BY score DESC, root) FILTER (NOT derived), list(score ORDER BY score DESC, root)), lambda a, b: a + b) AS total, CASE WHEN bool_or(NOT derived) THEN count(*) FILTER (NOT derived) ELSE count(*) END AS units, 2 * max(score) AS most FROM u GROUP BY q, cl),
    b AS (SELECT g.q, g.cl, g.root, g.p FROM (SELECT g.*, row_number() OVER (PARTITION BY g.q, g.cl ORDER BY u.score DESC, u.root, g.score DESC, g.root) AS nth FROM g JOIN u USING (q, cl, fp)) g WHERE nth = 1),
    v AS (SELECT q, cl, bool_and(seen) AS seen FROM (SELECT q, cl, vw, bool_or(seen) AS seen FROM g GROUP BY q, cl, vw) GROUP BY q, cl),
    a AS (SELECT q, cl, max(flo) AS flo, sum(n)::INTEGER AS n, bool_or(exact) AS exact, bool_or(alias) AS alias, bool_or(named) AS named, list_distinct(flatten(list(prints))) AS prints, string_agg(root, ',' ORDER BY root) AS members FROM g GROUP BY q, cl),
    x AS (SELECT *, least(total, most) AS score, exact AND (alias OR CASE q % 3 WHEN 0 THEN false WHEN 1 THEN q % 2 = 1 OR named ELSE true END) AS promoted FROM t JOIN b USING (q, cl) JOIN v USING (q, cl) JOIN a USING (q, cl)),
    d AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY promoted DESC, score DESC, CASE WHEN score = 0 THEN p.rnk ELSE 0 END, p.s || ':' || p.key, p.s, root) AS pos FROM x),
    w AS (SELECT q, f AS floor, 0::BIGINT AS pos, []::VARCHAR[] AS shown, NULL::VARCHAR AS reason FROM (SELECT DISTINCT q FROM d), (VALUES ({FLOOR}), (0)) t(f)
        UNION ALL SELECT q, floor, pos, CASE WHEN reason IS NULL THEN list_concat(shown, prints) ELSE shown END, reason FROM (SELECT w.q, w.floor, d.pos, w.shown, d.prints, CASE WHEN w.floor > 0 AND NOT d.exact AND d.flo < w.floor THEN 'relevance_floor' WHEN d.q % 5 = 0 AND d.seen THEN 'lineage_seen' WHEN list_has_any(w.shown, d.prints) THEN 'duplicate' END AS reason FROM w JOIN d ON d.q = w.q AND d.pos = w.pos + 1)),
    z AS (SELECT d.*, w.reason FROM d JOIN w USING (q, pos) JOIN (SELECT q, CASE WHEN count(*) FILTER (floor > 0 AND reason IS NULL AND pos > 0) > 0 THEN {FLOOR} ELSE 0 END AS floor FROM w GROUP BY q) y USING (q) WHERE w.floor = y.floor),
    h AS (SELECT *, row_number() OVER (PARTITION BY q, p.s ORDER BY pos) > {PER_SOURCE} AS tail FROM z WHERE reason IS NULL),
    fin AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tail, pos)::INTEGER AS position FROM h),
    res AS (SELECT * FROM fin WHERE position <= {LIMIT}),
    led AS (SELECT q, reason, n, root, NULL::VARCHAR AS fused_into FROM z WHERE reason IS NOT NULL UNION ALL SELECT q, 'diversity', n, root, NULL FROM fin WHERE position > {LIMIT} AND tail
        UNION ALL SELECT q, 'duplicate_view', 1, o.root, o.into_ FROM (SELECT g.q, g.root, res.root AS into_, row_number() OVER (PARTITION BY g.q, g.cl, g.vw ORDER BY g.score DESC, g.root) AS nth FROM g JOIN res ON g.q = res.q AND g.cl = res.cl) o WHERE nth > 1)"""

_fused: dict = {}


def fused(spark, d):
    """(results, suppressions) of the pool, made once per session and folder."""
    at = (spark.sparkContext.applicationId, d)
    if at in _fused:
        return _fused[at]
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("query_id"), (number + F.col("o_custkey") % 50).cast("long").alias("key"))
    found = F.array_compact(F.array(*(F.when(F.col("key") % n == r, F.lit(f"s{n}")) for n, r in ((2, 0), (3, 0), (5, 1)))))
    c = o.withColumn("source_uid", F.explode(found)).withColumn("local_rank", F.row_number().over(Window.partitionBy("query_id", "source_uid").orderBy("key")))
    key, text = F.col("key"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    n, m = F.floor(key / 2), F.floor(key / 4)
    one = m % 3 == 0
    c = c.withColumns({
        "source_id": F.col("source_uid"), "local": text(key), "candidate_id": text(F.col("source_uid"), "/", key), "record_type": F.lit("task"),
        "derived_from": F.when(F.col("source_uid") != "s5", F.array(text("s0:r", n))), "relevance": F.when(key % 13 == 0, F.lit(float("nan"))).otherwise((key % 11) / 8.0 - 0.2),
        "match_signals": F.array_compact(F.array(F.lit("lexical"), F.when(key % 11 == 0, F.lit("exact_identifier")), F.when(key % 22 == 0, F.lit("alias")))), "metadata": F.create_map(F.lit("name"), text("N", key % 7)),
        "source_record_id": F.when(one, text("rec", m)), "source_revision": F.when(one, F.lit("v")), "content_fingerprint": text("p", F.when(one, m % 5).otherwise(n % 5)), "entity_id": F.when(m % 5 < 4, text("e", m % 3)),
    }).withColumn("relevance", F.when(key % 7 != 0, F.col("relevance")))
    sources = values(spark, [("s0", 1.0, None, None), ("s2", 1.0, {"natural_language": 1.5}, None), ("s3", 1.0, {}, None), ("s5", 0.2, None, "s0")], "source_uid string, base_prior double, intent_priors map<string,double>, derives_from string")
    q = o.groupBy("query_id").agg(F.array_distinct(F.collect_list(F.when(n % 2 == 0, text("s0:r", n)))).alias("suppress_lineages"))
    kind = F.col("query_id") % 3
    q = q.withColumns({"query_class": F.when(kind == 0, "natural_language").when(kind == 1, "identifier_query").otherwise(""), "stable_identifiers": F.when(F.col("query_id") % 2 == 0, F.array(F.lit("n3"))).otherwise(F.array().cast("array<string>")), "mode": F.when(F.col("query_id") % 5 == 0, "pre_reply")})
    _fused[at] = U.fuse(conform(c, CANDIDATE), conform(sources.withColumn("source_id", F.col("source_uid")), SOURCE), conform(q, QUERY), FLOOR, limit=LIMIT, per_source=PER_SOURCE)
    return _fused[at]


def results(spark, d):
    r = fused(spark, d)[0]
    return r.withColumns({"score": F.round("score", 9), "members": F.array_join("members", ",")})


def withheld(spark, d, reason):
    return fused(spark, d)[1].where(F.col("reason") == reason).select("query_id", F.col("lineage_root").alias("root"), F.col("count").alias("n"))


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, position, root AS lineage_root, p.s AS source_uid, p.key AS local, round(score, 9) AS score, promoted AS exact_promoted, units::INTEGER AS independent_units, total > most AS cap_applied, p.rnk::INTEGER AS local_rank, p.pool_size::INTEGER AS pool_size, p.prior AS prior, members FROM res")
def fused_results(spark, d):
    return results(spark, d).select("query_id", "position", "lineage_root", "source_uid", "local", "score", "exact_promoted", "independent_units", "cap_applied", "local_rank", "pool_size", "prior", "members")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, reason, n AS count, root AS lineage_root, fused_into FROM led")
def fused_suppressions(spark, d):
    return fused(spark, d)[1]


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, n FROM led WHERE reason = 'relevance_floor'")
def relevance_floor(spark, d):
    """Clusters below the floor; where it would leave a query nothing it stands down."""
    return withheld(spark, d, "relevance_floor")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, n FROM led WHERE reason = 'duplicate'")
def near_duplicate(spark, d):
    return withheld(spark, d, "duplicate")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, n FROM led WHERE reason = 'diversity'")
def diversity_cap(spark, d):
    """Results beyond the share of their source, cut off by the limit."""
    return withheld(spark, d, "diversity")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, n FROM led WHERE reason = 'lineage_seen'")
def lineage_suppression(spark, d):
    return withheld(spark, d, "lineage_seen")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, fused_into FROM led WHERE reason = 'duplicate_view'")
def duplicate_view(spark, d):
    """Views of one record: the strongest stays, the others are folded into it."""
    return fused(spark, d)[1].where("reason = 'duplicate_view'").select("query_id", F.col("lineage_root").alias("root"), "fused_into")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, position FROM res WHERE promoted")
def exact_promotion(spark, d):
    return results(spark, d).where("exact_promoted").select("query_id", F.col("lineage_root").alias("root"), "position")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, p.s AS source_uid, p.key AS local FROM res")
def group_primary(spark, d):
    """Of a group's candidates, the first by prior, rank and locator."""
    return results(spark, d).select("query_id", F.col("lineage_root").alias("root"), "source_uid", "local")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, members, units::INTEGER AS units FROM res")
def entity_clusters(spark, d):
    return results(spark, d).select("query_id", "members", F.col("independent_units").alias("units"))


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, root, round(score, 9) AS score, total > most AS cap_applied FROM res")
def corroboration_cap(spark, d):
    return results(spark, d).select("query_id", F.col("lineage_root").alias("root"), "score", "cap_applied")


@query(f"WITH {FUSION_SQL} SELECT q AS query_id, count(*) AS n FROM res GROUP BY q")
def limit_ledger(spark, d):
    """Results of each query, at most the limit."""
    return results(spark, d).groupBy("query_id").agg(F.count("*").alias("n"))
