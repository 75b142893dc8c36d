"""More registered queries: condition ladders, ledgers, projections, evaluation details and log states."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwell.catalog import JUDGED_SQL, POOL_SQL, WORDS_SQL, batch, federated, judged, pool, query, scored, table, tok, values
from braidwell.functions import text as X
from braidwell.operators import documents as D
from braidwell.operators import expand as E
from braidwell.operators import fusion as U
from braidwell.operators import lineage as L
from braidwell.operators import records as R
from braidwell.plans import evaluate as V
from braidwell.plans import planning as P
from braidwell.plans import shape as H
from braidwell.schema import CANDIDATE, QUERY, conform
from braidwell.shared import saved, shared_dir
from braidwell.streaming import appends
from braidwell.streaming import events as S

# text and queries

TASK_WORDS = "(" + ", ".join(f"'{w}'" for w in X.TASK_STOP_WORDS) + ")"


@query(f"""SELECT item_id, array_to_string(list_slice(list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda p: list_position(k, p[1]) = p[2]), lambda p: p[1]), 1, 12), ' ') AS terms
    FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND length(t) <= 128 AND t NOT IN {TASK_WORDS}) AS k FROM benchmark)""")
def issue_query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.ascii_terms(F.col("text"), 3), " ").alias("terms"))


@query(r"""WITH t AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(trim(replace(replace(url, '/', ' '), '?', ' ')), '\s+'), lambda w: rtrim(regexp_replace(regexp_replace(w, '^["''()\[\]{}<>,;!?:]+', ''), '["''()\[\]{}<>,;!?:]+$', ''), '.')), lambda w: w <> '') AS w FROM pages)
    SELECT page_id, array_to_string(list_transform(list_filter(w, lambda x: regexp_matches(x, '[/\\:@#.]') OR regexp_matches(x, '^[\p{L}\p{Nd}-]+(_[\p{L}\p{Nd}-]+)+$') OR (contains(x, '-') AND regexp_matches(x, '\p{L}') AND regexp_matches(x, '\p{Nd}'))
        OR (length(x) >= 8 AND length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^\p{Nd}]', '', 'g')) >= 2)), lambda x: lower(x)), ' ') AS identifiers FROM t""")
def stable_identifiers(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(X.stable_identifiers(F.translate("url", "/?", "  ")), " ").alias("identifiers"))


@query(rf"""WITH p AS (SELECT doc_id, source || '/' || lang || '-notes/part_' || doc_id || '.md' AS path, lang || '-notes/part_' || doc_id AS x FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([array_to_string({tok('path')}, ' '), array_to_string({tok("'part_' || doc_id || '.md'")}, ' '), array_to_string({tok("left(path, -3)")}, ' '), array_to_string({tok("'part_' || doc_id")}, ' ')], lambda s: contains(s, ' ')))), '|') AS identifiers FROM p""")
def path_identifiers(spark, d):
    path = F.concat("source", F.lit("/"), "lang", F.lit("-notes/part_"), "doc_id", F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.path_identifiers(path)), "|").alias("identifiers"))


@query("""SELECT doc_id, CASE WHEN length(h) <= 120 THEN h ELSE CASE WHEN regexp_replace(left(h, 119), '\\s+\\S*$', '') = '' THEN left(h, 119) ELSE regexp_replace(left(h, 119), '\\s+\\S*$', '') END || '…' END AS headline, 'Doc > ' || lang || ' > ' || source AS title
    FROM (SELECT *, regexp_replace(regexp_replace(string_split(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(10))[1], '^\\s+', ''), '\\s+$', '') AS h FROM documents)""")
def headline_and_title(spark, d):
    return table(spark, d, "documents").select("doc_id", X.headline(F.col("text")).alias("headline"), X.chunk_title(F.lit("Doc"), F.array(F.lit("Doc"), "lang", "source")).alias("title"))


@query("SELECT doc_id, regexp_extract(s, '^@@ -(\\d+),(\\d+) @@', 1)::INTEGER AS line, regexp_extract(s, '^@@ -(\\d+),(\\d+) @@', 2)::INTEGER AS n, length(text) AS body FROM (SELECT doc_id, text, '@@ -' || doc_id || ',4 @@ (x)' || chr(10) || text AS s FROM documents)")
def span_header(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.concat(F.lit("@@ -"), "doc_id", F.lit(",4 @@ (x)\n"), "text").alias("s"))
    h = R.span_header(F.col("s"))
    return s.select("doc_id", h["line"].alias("line"), h["lines"].alias("n"), F.length(h["body"]).cast("long").alias("body"))


# planning


@query("""SELECT event_id, least(2000, floor(value)::BIGINT * 10 - 25) AS allowed, CASE WHEN value * 8 > least(2000, floor(value)::BIGINT * 10 - 25) THEN 'timeout' ELSE 'success' END AS outcome FROM events""")
def deadlines(spark, d):
    e = table(spark, d, "events").withColumn("allowed", P.deadline(F.lit(2000).cast("long"), F.floor("value") * 10))
    return e.select("event_id", "allowed", P.within_deadline(F.lit("success"), F.col("value") * 8, F.col("allowed")).alias("outcome"))


@query("""SELECT code, count(*) AS n, any_value(CASE code WHEN 'deadline' THEN 'timeout' WHEN 'denied' THEN 'denied' WHEN 'unreachable' THEN 'unavailable' WHEN 'as_of_unsupported' THEN 'skipped' ELSE 'failed' END) AS outcome,
    any_value(CASE code WHEN 'deadline' THEN 'timeout' WHEN 'other' THEN 'failed' ELSE code END) AS reason FROM (SELECT (['deadline', 'denied', 'unreachable', 'as_of_unsupported', 'budget_exceeded', 'cancelled', 'other'])[event_id % 7 + 1] AS code FROM events) GROUP BY code""")
def error_classes(spark, d):
    codes = F.array(*map(F.lit, ("deadline", "denied", "unreachable", "as_of_unsupported", "budget_exceeded", "cancelled", "other")))
    e = table(spark, d, "events").select(F.element_at(codes, (F.col("event_id") % 7 + 1).cast("int")).alias("code"))
    outcome, reason = P.classify_error(F.col("code"))
    return e.groupBy("code").agg(F.count("*").alias("n")).select("code", "n", outcome.alias("outcome"), reason.alias("reason"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 7 = 0 THEN 'none' WHEN p_size % 7 < 4 THEN 'partial' ELSE 'complete' END AS coverage, CASE WHEN p_size % 5 = 0 THEN 'unavailable' WHEN p_size % 3 > 0 OR p_size % 11 = 0 THEN 'degraded' ELSE 'healthy' END AS health,
    CASE WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 4 = 1 THEN 3 WHEN p_size % 4 = 2 THEN 4 ELSE 0 END AS code, CASE WHEN p_size > 25 THEN 'advanced' WHEN p_size = 25 THEN 'unchanged' ELSE 'regressed' END AS progress FROM part""")
def state_ladders(spark, d):
    n = F.col("p_size")
    some = lambda c: F.when(n % 5 != 0, c)
    health, _ = P.health(some(F.lit("a")), F.when(n % 3 > 0, F.lit("b")).otherwise(F.lit("a")), (n % 11 == 0).cast("int"))
    code = P.exit_code(F.when(n % 4 == 0, F.lit("failed")).when(n % 4 == 2, F.lit("abstained")).otherwise(F.lit("answered")), F.when(n % 4 < 2, F.lit("degraded")).otherwise(F.lit("complete")))
    vectors = F.when(n % 7 == 0, 0).when(n % 7 < 4, 3).otherwise(10)
    return table(spark, d, "part").select("p_partkey", P.index_coverage(some(F.lit(10)), vectors).alias("coverage"), health.alias("health"), code.alias("code"), S.progress(F.lit(25), n).alias("progress"))


@query("SELECT source_uid, local, source_id, malformed FROM (SELECT 'core' AS source_uid, o_orderkey::VARCHAR AS local, 'orders' AS source_id FROM orders WHERE o_orderkey % 10 > 0), (SELECT count(*) AS malformed FROM orders WHERE o_orderkey % 10 = 0)")
def identity_stamp(spark, d):
    c = table(spark, d, "orders").select(F.lit("claimed").alias("source_uid"), F.lit("claimed").alias("source_id"), F.col("o_orderkey").cast("string").alias("local"), (F.col("o_orderkey") % 10).cast("int").alias("local_rank"))
    good, bad = P.stamped(c, "core", "orders")
    return good.select("source_uid", "local", "source_id").crossJoin(bad)


@query("SELECT sum(n)::BIGINT AS total FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) WHERE o_orderstatus IN ('O', 'P')")
def scope_total(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return R.scope_total(counts, ["O", "P"])


@query("""SELECT id, CASE WHEN known IS NULL THEN 'source_not_configured' ELSE 'out_of_profile' END AS reason FROM (SELECT DISTINCT source AS id FROM documents UNION SELECT 'gone') LEFT JOIN (SELECT DISTINCT source AS id, 1 AS known FROM documents) USING (id) WHERE known IS NULL OR id NOT IN ('src0', 'src1')""")
def scope_problems(spark, d):
    sources = table(spark, d, "documents").select(F.col("source").alias("source_id")).distinct()
    asked = sources.union(values(spark, [("gone",)], "source_id string"))
    return P.unsatisfiable(asked, sources, values(spark, [("src0",), ("src1",)], "source_id string")).withColumnRenamed("source_id", "id")


# the way of a query


QUOTED_SQL = """q AS (SELECT item_id AS query_id, array_to_string(list_slice(w, 1, 3), ' ') || ' what "' || array_to_string(list_slice(w, 4, 6), ' ') || ' the who" is the' AS query FROM (SELECT item_id, regexp_split_to_array(text, '\\s+') AS w FROM benchmark))"""


def quoted(spark, d):
    w = F.split("text", r"\s+")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.array_join(F.slice(w, 1, 3), " "), F.lit(' what "'), F.array_join(F.slice(w, 4, 3), " "), F.lit(' the who" is the')).alias("query"))


@query(f"""WITH {QUOTED_SQL}, s AS (SELECT query_id, unnest(string_split(query, '"')) AS part, generate_subscripts(string_split(query, '"'), 1) AS i FROM q), t AS (SELECT query_id, i % 2 = 0 AS inside, unnest({tok('part')}) AS term FROM s),
    k AS (SELECT query_id, term, bool_or(inside OR term NOT IN {WORDS_SQL}) AS content FROM t GROUP BY ALL), n AS (SELECT query_id, bool_or(NOT (inside OR term NOT IN {WORDS_SQL})) AND bool_or(inside OR term NOT IN {WORDS_SQL}) AS normalized FROM t GROUP BY query_id)
    SELECT query_id, term, normalized, NOT normalized OR content AS content FROM k JOIN n USING (query_id)""")
def quoted_query_terms(spark, d):
    """Function words in double quotes are content."""
    return D.query_terms(quoted(spark, d))


@query(r"""SELECT page_id, CASE WHEN n = 0 THEN '' WHEN n = 1 OR stable THEN 'identifier_query' ELSE 'natural_language' END AS query_class FROM (SELECT page_id, len(regexp_extract_all(u, '[\p{L}\p{N}]+')) AS n, regexp_matches(u, '[:.]') OR len(list_filter(string_split(u, ' '), lambda x: contains(x, '-') AND regexp_matches(x, '\p{L}') AND regexp_matches(x, '\p{Nd}')
        OR regexp_matches(x, '^[\p{L}\p{Nd}-]+(_[\p{L}\p{Nd}-]+)+$') OR regexp_matches(x, '[\\@#]') OR (length(x) >= 8 AND length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^\p{Nd}]', '', 'g')) >= 2))) > 0 AS stable
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'where is page ' || page_id WHEN 1 THEN '?' WHEN 2 THEN 'one' || page_id ELSE replace(replace(url, '/', ' '), '?', ' ') END AS u FROM pages))""")
def query_classes(spark, d):
    p, n = table(spark, d, "pages"), F.col("page_id") % 4
    text = F.when(n == 0, F.concat(F.lit("where is page "), "page_id")).when(n == 1, F.lit("?")).when(n == 2, F.concat(F.lit("one"), "page_id")).otherwise(F.translate("url", "/?", "  "))
    return D.analysed(p.select("page_id", text.alias("query"))).select("page_id", "query_class")


def ranked_orders(spark, d):
    o = table(spark, d, "orders")
    return o, o.select((F.col("o_custkey") % 5).alias("query_id"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy(F.col("o_custkey") % 5).orderBy("o_orderkey")).alias("rank"), F.when(F.col("o_orderkey") % 9 == 0, 1).alias("mention"), F.lit(0.5).alias("relevance")).where("rank <= 20")


@query("""SELECT o_custkey % 5 AS query_id, o_orderkey::VARCHAR AS local, 'task' AS record_type, rank::INTEGER AS local_rank, CASE WHEN o_orderkey % 2 = 0 THEN 'head ' || o_orderkey ELSE o_orderpriority END || CASE WHEN o_orderkey % 3 = 0 THEN ' \u2014 note' ELSE '' END AS excerpt, CASE WHEN o_orderkey % 9 = 0 THEN 'exact_identifier,lexical' ELSE 'lexical' END AS signals, o_orderstatus = 'F' AS closed
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 20""")
def task_candidates(spark, d):
    o, found = ranked_orders(spark, d)
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    t = o.select(k.alias("id"), F.col("o_orderpriority").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("head "), k)).alias("headline"), F.when(k % 3 == 0, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")).alias("notes"), at.alias("at"), F.when(F.col("o_orderstatus") == "F", at).alias("closed"))
    c = D.of_types(D.task_candidates(found, t, "u-tasks", "tasks"), ["task"])
    return c.select("query_id", "local", "record_type", "local_rank", "excerpt", F.array_join("match_signals", ",").alias("signals"), F.col("valid_to").isNotNull().alias("closed"))


@query("""SELECT o_custkey % 5 AS query_id, o_orderkey::VARCHAR AS source_record_id, o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN ' \u2014 ' || o_orderstatus ELSE '' END AS excerpt, substr(sha256('store' || chr(0) || o_orderkey || chr(0) || strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S')), 1, 16) AS content_fingerprint
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 20""")
def issue_candidates(spark, d):
    o, found = ranked_orders(spark, d)
    at = F.col("o_orderdate").cast("timestamp")
    i = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("description"), at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("timestamp").alias("closed_at"))
    return D.issue_candidates(found, i, "u-issues", "issues", "store").select("query_id", "source_record_id", "excerpt", "content_fingerprint")


@query("""SELECT o_custkey % 5 AS query_id, o_orderkey::VARCHAR AS local, 'message' AS record_type, 'c' || o_custkey || ' \u2014 ' || o_orderpriority AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 20""")
def thread_candidates(spark, d):
    o, found = ranked_orders(spark, d)
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"), F.concat(F.lit("c"), "o_custkey").alias("sender"), F.lit(None).cast("timestamp").alias("at"))
    return D.thread_candidates(found, t, "u-mail", "mail").select("query_id", "local", "record_type", "excerpt")


@query("""SELECT o_custkey % 5 AS query_id, o_orderkey::VARCHAR AS local, 'matched' AS excerpt_kind, o_orderpriority AS excerpt, 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 9 = 0 THEN 'exact_identifier,semantic' ELSE 'semantic' END AS signals FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 20""")
def semantic_candidates(spark, d):
    o, found = ranked_orders(spark, d)
    h = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), "o_orderkey").alias("file"), F.lit("t").alias("title"), F.col("o_orderpriority").alias("body"))
    return D.semantic_candidates(found, h, "u-sem", "sem").select("query_id", "local", "excerpt_kind", "excerpt", F.col("metadata")["path"].alias("path"), F.array_join("match_signals", ",").alias("signals"))


# lineage and fusion


@query("""SELECT child, parent FROM (SELECT 'u-orders:' || o_orderkey AS child, CASE o_orderkey % 3 WHEN 0 THEN 'u-cust:' || o_custkey WHEN 1 THEN 'u-cust:x:' || o_custkey END AS parent FROM orders WHERE o_orderkey % 5 > 0) WHERE parent IS NOT NULL""")
def parent_edges(spark, d):
    """Edges of records that name their sources by id or uid; unknown sources are dropped and listed."""
    o = table(spark, d, "orders").where("o_orderkey % 5 > 0")
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, F.concat(F.lit("customers:"), "o_custkey")).when(k == 1, F.concat(F.lit("u-cust:x:"), "o_custkey")).otherwise(F.concat(F.lit("nowhere:"), "o_custkey"))
    c = o.select(F.lit(1).alias("query_id"), F.lit("u-orders").alias("source_uid"), F.col("o_orderkey").cast("string").alias("local"), F.array(name).alias("derived_from"))
    s = values(spark, [("u-orders", "orders"), ("u-cust", "customers")], "source_uid string, source_id string")
    return L.parent_edges(c, s)[0].select("child", "parent")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'u-a' WHEN o_orderkey % 3 = 1 THEN 'u-b' END END AS source_derives_from FROM orders")
def source_derivation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("s"), F.col("o_orderkey") % 3).alias("source_uid"), F.when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("x:1"))).alias("derived_from"))
    s = values(spark, [("s0", "n0", "a"), ("s1", "n1", "u-b"), ("s2", "n2", None), ("u-a", "a", None), ("u-b", "b", None)], "source_uid string, source_id string, derives_from string")
    return L.source_derivation(o, s).select("o_orderkey", "source_derives_from")


@query("SELECT p_partkey, greatest(0.5, least(2.0, CASE WHEN p_size % 3 = 0 THEN p_size / 20.0 ELSE p_size / 10.0 END))::DOUBLE AS prior FROM part")
def intent_prior(spark, d):
    p = table(spark, d, "part").withColumn("intents", F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("natural_language"), F.col("p_size") / 20.0)))
    return p.select("p_partkey", U.prior(F.col("p_size") / 10.0, F.col("intents"), F.lit("natural_language")).alias("prior"))


@query()
def fused_ledger(spark, d):
    """What the selection of the federated search withheld, and why."""
    queries = saved(batch(spark, d))
    candidates, sources = federated(spark, d, queries)
    asked = conform(queries.withColumn("query_class", F.lit("natural_language")).withColumn("stable_identifiers", F.array().cast("array<string>")), QUERY)
    _, ledger = U.fuse(saved(candidates).select(CANDIDATE.names), sources, asked)
    return ledger.groupBy("reason").agg(F.count("*").alias("n"), F.sum("count").alias("candidates"))


# shaping and expansion


@query("""SELECT event_id, (length('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') + 3) // 4 AS structured, 2 * ((length('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') + 3) // 4) AS tool, (length(event_type) + 3) // 4 + 2 AS explained FROM events""")
def cost_models(spark, d):
    c = ["event_id", "event_type"]
    return table(spark, d, "events").select("event_id", H.structured_cost(c).alias("structured"), H.tool_cost(c).alias("tool"), H.explained_cost(F.col("event_type")).alias("explained"))


@query("""SELECT o_orderkey, budget > 0 AND ("full" > budget OR "full" + 5 > budget) AND summary < "full" AS cut, CASE WHEN budget > 0 AND ("full" > budget OR "full" + 5 > budget) AND summary < "full" THEN summary ELSE "full" END AS frame
    FROM (SELECT o_orderkey, (o_orderkey % 200)::BIGINT AS budget, 100::BIGINT AS "full", (90 + o_orderkey % 20)::BIGINT AS summary FROM orders)""")
def frame_trim(spark, d):
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select("o_orderkey", (k % 200).alias("budget"), F.lit(100).cast("long").alias("full"), (k % 20 + 90).alias("summary"), F.lit(5).cast("long").alias("first"))
    return H.trimmed(f).select("o_orderkey", "cut", "frame")


@query(f"""WITH {POOL_SQL} SELECT query_id, local_rank AS rank, source_uid || ':' || key AS locator, key % 37 = 0 AS exact, CASE WHEN key % 4 > 1 THEN (key % 4)::INTEGER END AS corroboration, 'x' AS title FROM pool""")
def pointer_projection(spark, d):
    k = F.col("key")
    r = pool(spark, d).select("query_id", F.col("local_rank").cast("long").alias("position"), F.col("source_uid").alias("source_id"), k.cast("string").alias("local"), F.lit("x").alias("title"), F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("string").alias("excerpt_kind"), (k % 37 == 0).alias("exact_promoted"), (k % 4).cast("int").alias("independent_units"))
    return H.pointer(r).select("query_id", "rank", "locator", "exact", "corroboration", "title")


@query(f"""WITH {POOL_SQL} SELECT query_id, key, 's rank ' || local_rank || ' of 9, prior ' || printf('%.2f', (key % 4) / 2.0) || ', score ' || printf('%.6f', key / 10000.0) || CASE WHEN key % 3 > 1 THEN '; 2 independent units from a, b' ELSE '' END || CASE WHEN key % 5 = 0 THEN '; exact match promoted' ELSE '' END AS text FROM pool""")
def explanation_text(spark, d):
    k = F.col("key")
    r = pool(spark, d).select("query_id", "key", F.lit("s").alias("source_id"), "local_rank", F.lit(9).alias("pool_size"), ((k % 4) / 2.0).alias("prior"), (k / 10000.0).alias("score"), F.lit(None).cast("double").alias("relevance"), (k % 3).cast("int").alias("independent_units"), F.array(F.lit("a"), F.lit("b")).alias("sources"), F.lit(False).alias("cap_applied"), (k % 5 == 0).alias("exact_promoted"))
    return r.select("query_id", "key", H.explanation(r).alias("text"))


@query("""WITH g AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS dep, list_sort(list(DISTINCT l_shipmode)) AS x FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE l_orderkey < 500 GROUP BY 1)
    SELECT o_orderkey AS id, array_to_string(dep, ',') AS depends_on, array_to_string(x, ',') AS files FROM orders LEFT JOIN g ON id = o_orderkey WHERE o_orderkey < 500""")
def issue_context(spark, d):
    li = table(spark, d, "lineitem").where("l_orderkey < 500")
    deps = li.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("depends_on"))
    files = li.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("path"))
    logs = values(spark, [], "id long, at int, line string")
    i = table(spark, d, "orders").where("o_orderkey < 500").select(F.col("o_orderkey").alias("id"))
    out = E.issue_context(i, deps.withColumn("id", F.col("id")), files, logs)
    return out.select("id", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("files", ",").alias("files")).dropDuplicates(["id"])


@query("SELECT conv_id::VARCHAR AS note_id, 1 AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE conv_id < 50 GROUP BY conv_id")
def note_context(spark, d):
    c = table(spark, d, "conversations").where("conv_id < 50")
    sections = c.select(F.col("conv_id").cast("string").alias("note_id"), F.col("turn").alias("ordinal"), F.col("text").alias("body"))
    return E.note_context(sections, c.select(F.concat("conv_id", F.lit("#1")).alias("locator")).distinct())


# evaluation


@query("""WITH e AS (SELECT doc_id // 20 AS case_id, doc_id AS root, quality, toxic FROM labels) SELECT case_id, avg(CASE WHEN root % 7 > 0 AND (root % 3 > 0 OR quality = 1) THEN 1.0 ELSE 0.0 END)::DOUBLE AS locator_success,
    avg(1.0 - toxic)::DOUBLE AS provenance_accuracy, avg(CASE WHEN root % 2 = quality THEN 1.0 ELSE 0.0 END)::DOUBLE AS source_outcome_accuracy FROM e GROUP BY case_id""")
def case_accuracies(spark, d):
    lab = table(spark, d, "labels").withColumn("case_id", (F.col("doc_id") / 20).cast("long")).withColumn("root", F.col("doc_id"))
    expansions = lab.select("case_id", F.when(F.col("root") % 7 > 0, F.col("root")).alias("root"), F.concat(F.lit("v"), "quality").alias("revision"))
    want = lab.where("root % 3 = 0").select("case_id", "root", F.lit("v1").alias("want"))
    outcomes = lab.select("case_id", F.col("root").cast("string").alias("source_uid"), F.col("quality").cast("string").alias("outcome"))
    expected = lab.select("case_id", F.col("root").cast("string").alias("source_uid"), (F.col("root") % 2).cast("string").alias("want"))
    return V.case_accuracies(expansions, want, lab.select("case_id", (F.col("toxic") == 0).alias("correct")), outcomes, expected)


@query("SELECT doc_id // 20 AS case_id, count(*) FILTER (doc_id % 4 > 1) AS violations FROM documents WHERE doc_id // 20 % 2 = 0 GROUP BY 1")
def ceiling_violations(spark, d):
    r = table(spark, d, "documents").select((F.col("doc_id") / 20).cast("long").alias("case_id"), (F.col("doc_id") % 4).alias("sensitivity"))
    cases = r.select("case_id").distinct().withColumn("ceiling", F.when(F.col("case_id") % 2 == 0, 1))
    return V.ceiling_violations(r, cases)


@query(f"""WITH {JUDGED_SQL}, f AS (SELECT j.case_id, bool_or(position <= 5) AS hit FROM j JOIN rk USING (case_id, root) WHERE forbidden GROUP BY ALL), m AS (SELECT j.case_id, round(coalesce(1.0 / min(position), 0), 6) AS mrr FROM j LEFT JOIN rk ON rk.case_id = j.case_id AND rk.root = j.root AND position <= 10 WHERE grade = 3 GROUP BY j.case_id)
    SELECT 'forbidden' AS gate, CASE WHEN count(*) FILTER (hit) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) FILTER (hit)::DOUBLE AS observed FROM f UNION ALL
    SELECT 'exact_identifier', CASE WHEN avg((mrr = 1)::INTEGER) < 0.4 THEN 'fail' ELSE 'pass' END, round(avg((mrr = 1)::INTEGER), 6) FROM m""")
def gate_kinds(spark, d):
    s = scored(spark, d).withColumn("tags", F.array(F.lit("exact")))
    return V.gates(s, {"exact_identifier_success_at_1": 0.4}).where("gate IN ('forbidden', 'exact_identifier')").select("gate", "status", "observed")


@query(f"""WITH {JUDGED_SQL}, m AS (SELECT j.case_id, round(coalesce(1.0 / min(position), 0), 6)::DOUBLE AS mrr FROM j LEFT JOIN rk ON rk.case_id = j.case_id AND rk.root = j.root AND position <= 10 WHERE grade = 3 GROUP BY j.case_id)
    SELECT case_id, 'm' AS metric, mrr AS before, CASE WHEN case_id % 3 > 0 THEN mrr / 2 END AS after FROM m WHERE case_id % 3 = 0 OR mrr > 0""")
def case_changes(spark, d):
    ranked, judgments = judged(spark, d)
    m = V.reciprocal_rank(ranked, judgments.where("grade = 3"), 10, "m")
    return V.case_changes(m, m.withColumn("m", F.when(F.col("case_id") % 3 > 0, F.col("m") / 2)), ["m"])


# logs


def log_lines(spark, d):
    e = table(spark, d, "events")
    odd = F.col("event_id") % 2 == 1
    return e.select(F.to_json(F.struct(F.when(odd, 2).otherwise(F.when(F.col("event_id") % 10 == 0, 3).otherwise(1)).alias("schema"), F.when(F.col("event_id") % 7 > 0, F.col("event_id").cast("string")).otherwise("").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("event_time"), F.col("event_type").alias("title"), F.when(~odd, F.lit("old")).alias("body"), F.when(odd, F.lit("new")).alias("text"), F.col("event_type").alias("system"), F.col("user_id").cast("string").alias("ref"))).alias("value"))


@query("SELECT (event_id % 7 > 0 AND (event_id % 2 = 1 OR event_id % 10 > 0)) AS ok, CASE WHEN event_id % 2 = 1 THEN 'new' WHEN event_id % 10 > 0 THEN 'old' END AS text, count(*) AS n FROM events GROUP BY ALL")
def log_records(spark, d):
    return S.parsed(log_lines(spark, d)).groupBy("ok", "text").agg(F.count("*").alias("n"))


def appended(spark, d, rounds):
    """A log that grows in rounds, each taken in before the next is appended; what the table then holds."""
    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for rows in rounds:
        appends.append_lines(rows, f"{root}/in", "event_id", 4)
        S.catch_up(spark, f"{root}/in", f"{root}/out", f"{root}/cursor")
    return spark.read.parquet(f"{root}/out")


def event_lines(spark, d, schema, title, days=0):
    e = table(spark, d, "events")
    at = F.date_format(F.col("ts") + F.make_dt_interval(F.lit(days)), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return e.select("event_id", F.to_json(F.struct(F.lit(schema).alias("schema"), F.col("event_id").cast("string").alias("id"), at.alias("event_time"), title.alias("title"), F.lit("t").alias("body"), F.lit("t").alias("text"))).alias("value"))


@query("SELECT schema, count(*) AS n, sum(event_id)::BIGINT AS ids, max(ts)::TIMESTAMP AS latest FROM (SELECT 1 AS schema, event_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 3 > 0 UNION ALL SELECT 1, event_id, date_trunc('second', ts) FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 2, event_id, date_trunc('second', ts) - INTERVAL 1 DAY FROM events WHERE event_id % 5 = 0) GROUP BY schema")
def log_append(spark, d):
    first = event_lines(spark, d, 1, F.lit("first"))
    taken = appended(spark, d, [first.where("event_id % 3 > 0"), first.where("event_id % 3 = 0"), event_lines(spark, d, 2, F.lit("second"), -1).where("event_id % 5 = 0")])
    return taken.where("ok").groupBy("schema").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"), F.max("event_time").cast("timestamp_ntz").alias("latest"))


@query("""SELECT 1 AS schema, event_id::VARCHAR AS id, CASE WHEN event_id % 4 = 0 THEN 'again' ELSE 'first' END AS title FROM events UNION ALL SELECT 2, event_id::VARCHAR, 'second' FROM events WHERE event_id % 5 = 0""")
def log_latest(spark, d):
    """Lines of two schemas with one id are two records; a later line of one identity counts, though it is dated earlier."""
    first, again, second = event_lines(spark, d, 1, F.lit("first")), event_lines(spark, d, 1, F.lit("again"), -9).where("event_id % 4 = 0"), event_lines(spark, d, 2, F.lit("second"), -5).where("event_id % 5 = 0")
    return S.latest(appended(spark, d, [first, second, again]).where("ok")).select("schema", "id", "title")


@query("SELECT count(*) AS records, 'records=' || count(*) || ' latest=' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS label FROM events")
def log_snapshot(spark, d):
    return S.snapshot(table(spark, d, "events").withColumnRenamed("ts", "event_time")).select("records", "label")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'u-orders:' || user_id WHEN 'signup' THEN 'u-users:' || user_id ELSE '' END AS origin FROM events")
def log_upstream(spark, d):
    e = table(spark, d, "events").withColumn("system", F.col("event_type")).withColumn("ref", F.col("user_id").cast("string"))
    return S.upstream(e, {"purchase": "u-orders", "signup": "u-users"}).select("event_id", F.array_join("derived_from", ",").alias("origin"))


@query("SELECT c_custkey::VARCHAR AS path FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 1 OR c_custkey % 5 = 2")
def log_rewrites(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit(10).alias("size"), F.lit("h").alias("head"), "c_custkey")
    now = c.where("c_custkey % 4 <> 0").select("path", F.when(F.col("c_custkey") % 6 == 1, 9).otherwise(11).alias("size"), F.when(F.col("c_custkey") % 5 == 2, "x").otherwise("h").alias("head"))
    return S.rewritten(c.drop("c_custkey"), now)
