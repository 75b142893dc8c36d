"""Registered queries of single rules: skips, health, filters, local order, folded views and what a response carries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwell.catalog import QUERIES_SQL, WORDS_SQL, batch, query, rel, table, tok, values
from braidwell.operators import documents as D
from braidwell.operators import expand as E
from braidwell.operators import records as R
from braidwell.plans import evaluate as V
from braidwell.plans import planning as P
from braidwell.plans import shape as H


def orders(spark, d):
    return table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'unreachable' WHEN o_orderkey % 5 = 0 THEN 'denied' WHEN o_orderkey % 5 = 1 THEN 'unavailable' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'as_of_unsupported' WHEN o_orderkey % 7 < 2 THEN 'record_type_mismatch' WHEN o_orderkey % 13 * 5 <= 25 THEN 'budget_exhausted' END AS reason FROM orders""")
def skip_reasons(spark, d):
    """Why a source that may be asked isn't, in order."""
    o = orders(spark, d)
    o = o.withColumns({"handshake_ok": F.col("k") % 11 != 0, "health": F.when(F.col("k") % 5 == 0, "denied").when(F.col("k") % 5 == 1, "unavailable").otherwise("healthy"), "as_of_support": F.when(F.col("k") % 2 == 0, "none").otherwise("exact"), "types": F.when(F.col("k") % 7 < 2, F.array(F.lit("note"))).otherwise(F.array(F.lit("task"), F.lit("note")))})
    as_of = F.when(F.col("k") % 3 == 0, F.current_timestamp())
    return o.select(F.col("k").alias("id"), P.dynamic_reason(F.array(F.lit("task")), as_of, F.col("k") % 13 * 5).alias("reason"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'unavailable' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'degraded' ELSE 'healthy' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'partial' ELSE 'complete' END AS coverage,
    CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 10 = 0 THEN 'none' WHEN o_orderkey % 10 < 5 THEN 'partial' ELSE 'complete' END AS vectors FROM orders""")
def index_health(spark, d):
    k = F.col("k")
    status, cover = P.health(F.when(k % 5 != 0, F.lit("m1")), F.when(k % 3 == 0, F.lit("m2")).otherwise(F.lit("m1")), F.when(k % 7 == 0, 1).otherwise(0))
    return orders(spark, d).select(k.alias("id"), status.alias("status"), cover.alias("coverage"), P.index_coverage(F.when(k % 4 != 0, F.lit(5)), k % 10).alias("vectors"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE CASE WHEN o_orderkey % 4 = 0 THEN 3 WHEN o_orderkey % 3 = 1 THEN 4 ELSE 0 END END AS cli, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 0 END END AS tool FROM orders""")
def exit_codes(spark, d):
    k = F.col("k")
    outcome, cover = F.when(k % 3 == 0, "failed").when(k % 3 == 1, "abstained").otherwise("answered"), F.when(k % 4 == 0, "degraded").otherwise("complete")
    return orders(spark, d).select(k.alias("id"), P.exit_code(outcome, cover).alias("cli"), P.exit_code(outcome, cover, "tool").alias("tool"))


REPORTS_SQL = """r AS (SELECT o_custkey AS query_id, 's' || o_orderkey AS source_id, CASE o_orderkey % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'timeout' WHEN 2 THEN 'partial' ELSE 'success' END AS outcome, CASE o_orderkey % 4 WHEN 0 THEN 'disabled' WHEN 1 THEN 'unreachable' WHEN 2 THEN '' END AS reason FROM orders)"""


@query(f"WITH {REPORTS_SQL} SELECT query_id, source_id, source_id || ': ' || outcome || CASE WHEN coalesce(reason, '') <> '' THEN ' (' || reason || ')' ELSE '' END AS text FROM r WHERE CASE WHEN outcome = 'skipped' THEN coalesce(reason, 'x') NOT IN ('disabled', 'not_applicable', 'out_of_scope', 'record_type_mismatch', 'sensitivity_ceiling') ELSE outcome <> 'success' END")
def degraded_sources(spark, d):
    """The reports that degrade an answer's coverage, in words."""
    k = F.col("k")
    r = orders(spark, d).select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("s"), k).alias("source_id"), F.when(k % 5 == 0, "skipped").when(k % 5 == 1, "timeout").when(k % 5 == 2, "partial").otherwise("success").alias("outcome"), F.when(k % 4 == 0, "disabled").when(k % 4 == 1, "unreachable").when(k % 4 == 2, "").alias("reason"))
    return P.degraded_list(r)


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 9 AS query_id, greatest(o_orderkey % 4, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END) AS sensitivity FROM orders) SELECT query_id, sensitivity::INTEGER AS sensitivity, count(*) AS n FROM c WHERE sensitivity <= 2 GROUP BY ALL""")
def raised_and_permitted(spark, d):
    """A source's floor raises what its candidates say; what is above the ceiling goes."""
    c = orders(spark, d).select((F.col("o_custkey") % 9).alias("query_id"), F.concat(F.lit("u"), F.col("k") % 3).alias("source_uid"), (F.col("k") % 4).cast("int").alias("sensitivity"))
    s = values(spark, [("u0", 1), ("u1", 3)], "source_uid string, sensitivity int")
    return P.permitted(P.raised(c, s), 2)[0].groupBy("query_id", "sensitivity").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_custkey % 5 = 2 OR o_custkey % 7 = 3)""")
def issue_filter(spark, d):
    """Any of each list; entities over labels, parents and sessions, without case."""
    c = F.col("o_custkey")
    i = orders(spark, d).withColumns({"status": F.lower("o_orderstatus"), "type": F.lower("o_orderpriority"), "labels": F.array(F.concat(F.lit("L"), c % 5)), "parent_id": F.when(c % 7 == 3, F.lit("P-3")), "sessions": F.lit(None).cast("array<string>")})
    return R.issue_filter(i, ["O", "P"], ["1-Urgent", "2-HIGH"], None, ["l2", "p-3"]).select(F.col("k").alias("id"))


@query("""WITH f AS (SELECT o_custkey % 40 AS query_id, o_orderkey AS chunk_id, round((o_orderkey % 17) / 4.0::DOUBLE, 6) AS score FROM orders WHERE o_orderkey % 3 > 0), e AS (SELECT o_custkey % 40 AS query_id, o_orderkey AS chunk_id, 1 AS x FROM orders WHERE o_orderkey % 37 = 0),
    b AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score, x IS NOT NULL AS exact FROM f FULL JOIN e USING (query_id, chunk_id)) SELECT query_id, chunk_id, exact, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, chunk_id)::INTEGER AS rank FROM b) WHERE rank <= 20""")
def local_order(spark, d):
    """Exact matches first, also those that no term found."""
    k, q = F.col("k"), (F.col("o_custkey") % 40).alias("query_id")
    o = orders(spark, d)
    found = o.where(k % 3 > 0).select(q, k.alias("chunk_id"), F.round((k % 17) / 4.0, 6).alias("score"), F.lit(0.5).alias("relevance"))
    return D.local_order(found, o.where(k % 37 == 0).select(q, k.alias("chunk_id"))).select("query_id", "chunk_id", "exact", "rank")


@query("""SELECT query_id, id, exact, rank FROM (SELECT o_custkey % 40 AS query_id, o_orderkey AS id, o_orderkey % 41 = 0 AS exact, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey % 41 = 0 DESC, o_totalprice, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 20""")
def promote_exact(spark, d):
    """The thread that was named goes first, the others as the store returned them."""
    t = orders(spark, d).select((F.col("o_custkey") % 40).alias("query_id"), F.col("k").alias("id"), F.struct("o_totalprice", "o_orderkey").alias("position"))
    return R.promote_exact(t, F.col("id") % 41 == 0).select("query_id", "id", "exact", "rank")


@query(f"""WITH {QUERIES_SQL}, w AS (SELECT query_id, list_distinct({tok('query')}) AS raw FROM queries), c AS (SELECT query_id, CASE WHEN len(list_filter(raw, lambda t: t NOT IN {WORDS_SQL})) > 0 THEN list_filter(raw, lambda t: t NOT IN {WORDS_SQL}) ELSE raw END AS want FROM w), t AS (SELECT query_id, len(want) AS n, unnest(want) AS term FROM c),
    h AS (SELECT doc_id AS id, {tok("source || ' ' || left(text, 400)")} AS have FROM documents), x AS (SELECT id, len(have) AS length, unnest(have) AS term FROM h), y AS (SELECT id, length, term, count(*) AS tf FROM x GROUP BY ALL),
    z AS (SELECT query_id, id, count(*) AS covered, sum(tf)::BIGINT AS hits, max(n) AS n, max(length) AS length FROM y JOIN t USING (term) GROUP BY ALL) SELECT query_id, id, round({rel('covered', 'n', 'hits', 'length')}, 6) AS relevance FROM z""")
def span_relevance(spark, d):
    """Lexical relevance of semantic hits, for modes whose native score isn't a similarity."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.substring("text", 1, 400).alias("body"))
    return R.span_relevance(items, batch(spark, d))


FOLDED_SQL = """k AS (SELECT o_custkey AS case_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders), r AS (SELECT case_id, position, 'r' || position AS root FROM k), a AS (SELECT case_id, root, 'r' || (position - 1) AS fused_into FROM r WHERE position % 3 = 0),
    j AS (SELECT case_id, root, position % 4 AS grade FROM r), rs AS (SELECT case_id, coalesce(fused_into, root) AS root, min(position) AS position FROM r LEFT JOIN a USING (case_id, root) GROUP BY ALL), js AS (SELECT case_id, coalesce(fused_into, root) AS root, max(grade) AS grade FROM j LEFT JOIN a USING (case_id, root) GROUP BY ALL)"""


@query(f"WITH {FOLDED_SQL} SELECT case_id, root, row_number() OVER (PARTITION BY case_id ORDER BY position)::INTEGER AS position, grade FROM rs JOIN js USING (case_id, root)")
def folded_views(spark, d):
    """Folded views read as what they were folded into, in rankings and in judgments."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    r = orders(spark, d).select(F.col("o_custkey").alias("case_id"), n.alias("position")).withColumn("root", F.concat(F.lit("r"), "position"))
    aliases = r.where("position % 3 = 0").select("case_id", "root", F.concat(F.lit("r"), F.col("position") - 1).alias("fused_into"))
    ranked, graded = V.canonical(r, r.select("case_id", "root", (F.col("position") % 4).cast("long").alias("grade"), F.lit(True).alias("required"), F.lit(False).alias("forbidden")), aliases)
    return ranked.join(graded, ["case_id", "root"]).select("case_id", "root", "position", "grade")


@query("""WITH s AS (SELECT o_custkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'duplicate' ELSE 'duplicate_view' END AS reason, 'r' || o_orderkey AS lineage_root, CASE WHEN o_orderkey % 3 > 0 THEN 'r' || (o_orderkey - o_orderkey % 2) END AS fused_into FROM orders)
    SELECT query_id, reason, lineage_root, fused_into FROM s WHERE reason = 'duplicate' OR (query_id, fused_into) IN (SELECT (o_custkey, 'r' || o_orderkey) FROM orders WHERE o_orderkey % 4 = 0)""")
def carried_suppressions(spark, d):
    """A folded view is told only beside the result it was folded into."""
    k, o = F.col("k"), orders(spark, d)
    view = k % 3 > 0
    s = o.select(F.col("o_custkey").alias("query_id"), F.when(view, "duplicate_view").otherwise("duplicate").alias("reason"), F.concat(F.lit("r"), k).alias("lineage_root"), F.when(view, F.concat(F.lit("r"), k - k % 2)).alias("fused_into"))
    return H.carried(s, o.where(k % 4 == 0).select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("r"), k).alias("lineage_root")))


@query("""SELECT o_custkey AS query_id, 's' || o_orderkey AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' WHEN 2 THEN 'success' ELSE 'skipped' END AS outcome, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'not_applicable' ELSE 'unstated_skip' END WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'timeout' ELSE 'failed' END WHEN 3 THEN 'disabled' END AS reason,
    CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 9 ELSE 0 END AS candidates FROM orders""")
def source_reports(spark, d):
    """One report for every source of a query, asked or not, with a reason of the known ones."""
    k, o = F.col("k"), orders(spark, d)
    q, s = F.col("o_custkey").alias("query_id"), F.concat(F.lit("s"), k).alias("source_id")
    asked = o.where(k % 4 < 3).select(
        q, s, F.when(k % 4 == 0, "skipped").when(k % 4 == 1, "failed").otherwise("success").alias("outcome"), F.when(k % 3 == 0, "not_applicable").otherwise("because").alias("stated"),
        F.when(k % 4 == 1, F.when(k % 3 == 0, "deadline").otherwise("boom")).alias("error"), (k % 9).alias("candidates"), F.lit(5).cast("long").alias("elapsed_ms"),
    )
    return P.reports(asked, o.where(k % 4 == 3).select(q, s, F.lit("disabled").alias("reason"))).select("query_id", "source_id", "outcome", "reason", "candidates")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'live' END AS mode, CASE o_orderkey % 3 WHEN 0 THEN 'rev' END AS revision, CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'exact' END AS as_of FROM orders""")
def freshness(spark, d):
    r = orders(spark, d).select(F.col("k").alias("id"), F.concat(F.lit("u"), F.col("k") % 3).alias("source_uid"))
    s = values(spark, [("u0", "indexed", "none"), ("u1", "live", "exact")], "source_uid string, freshness_mode string, as_of_support string")
    out = P.annotated(r, s, values(spark, [("u0", "rev", "gen-000001")], "source_uid string, revision string, generation string"))
    return out.select("id", "freshness.mode", "freshness.revision", F.col("freshness.as_of_honored").alias("as_of"))


EXPANDED_SQL = """b AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS l, 2 + doc_id % 3 AS a, CASE doc_id % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'excerpt' WHEN 2 THEN 'full' ELSE 'context' END AS detail FROM documents),
    c AS (SELECT *, least(a + 40, len(l)) AS z FROM b), e AS (SELECT *, CASE WHEN detail = 'context' THEN greatest(a - 20, 1) ELSE a END AS f, CASE WHEN detail = 'context' THEN least(z + 20, len(l)) ELSE z END AS t0 FROM c),
    g AS (SELECT *, detail = 'excerpt' AND t0 - f >= 12 AS long FROM e), h AS (SELECT *, CASE WHEN long THEN f + 11 ELSE t0 END AS t FROM g), i AS (SELECT *, CASE WHEN t >= f THEN l[f:t] ELSE [] END AS part FROM h),
    j AS (SELECT *, list_filter(list_transform(part, lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1] AS said FROM i), k AS (SELECT *, CASE WHEN detail = 'summary' THEN lang || coalesce(chr(10) || said, '') ELSE array_to_string(part, chr(10)) END AS body FROM j),
    m AS (SELECT *, detail = 'summary' AND length(body) > 400 AS cut FROM k)"""


@query(f"WITH {EXPANDED_SQL} SELECT doc_id, CASE WHEN cut THEN left(body, 400) ELSE body END || CASE WHEN cut THEN chr(10) || '\u2026 [truncated: summary_runes]' WHEN long THEN chr(10) || '\u2026 [truncated: excerpt_lines]' ELSE '' END AS content, CASE WHEN cut THEN 'summary_runes' WHEN long THEN 'excerpt_lines' END AS boundary, 'd/' || doc_id || '#L' || f || '-L' || t AS provenance FROM m")
def expanded_details(spark, d):
    """Lines of documents at four levels of detail."""
    i = F.col("doc_id")
    c = table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), "text", F.concat(F.lit("d/"), i, F.lit("#L"), 2 + i % 3, F.lit("-L"), 42 + i % 3).alias("locator"))
    detail = F.when(i % 4 == 0, "summary").when(i % 4 == 1, "excerpt").when(i % 4 == 2, "full").otherwise("context")
    return E.rendered(c, detail).select("doc_id", "content", "boundary", "provenance")


@query("""WITH t AS (SELECT doc_id, 'd/' || doc_id || '#L1-L' || len(string_split(text, chr(10))) AS provenance, text, CASE WHEN doc_id % 5 = 0 THEN 60 ELSE 64 + doc_id % 400 END AS budget FROM documents)
    SELECT doc_id, CASE WHEN budget < 64 THEN NULL WHEN strlen(text) > budget THEN 'budget_bytes' END AS boundary, CASE WHEN budget < 64 THEN 'budget_exceeded' END AS error, budget >= 64 AS fits FROM t""")
def expanded_budget(spark, d):
    """A budget of bytes is kept, at a character's end, or refused."""
    i = F.col("doc_id")
    c = table(spark, d, "documents").select("doc_id", F.lit("t").alias("title"), "text", F.concat(F.lit("d/"), i).alias("locator"), F.when(i % 5 == 0, 60).otherwise(64 + i % 400).cast("long").alias("budget"))
    out = E.rendered(c, F.lit("full"), F.col("budget"))
    plain = F.col("content") == F.col("text")
    head = F.expr("octet_length(content) <= budget AND octet_length(content) > budget - 4 AND is_valid_utf8(content) AND startswith(text, replace(content, '\n\u2026 [truncated: budget_bytes]', ''))")
    return out.select("doc_id", "boundary", "error", (F.coalesce(plain | head, F.lit(False)) & F.col("error").isNull()).alias("fits"))
