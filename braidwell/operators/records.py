"""Retrieval over structured records: streams, tasks, issues, mail, notes and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwell.functions import text as X
from braidwell.shared import saved

STREAM_WEIGHTS = {"title": 1.0, "metadata": 0.5, "text": 0.4}
NOTE_WEIGHTS = {"title": 1.0, "heading": 0.8, "tag": 0.6, "body": 0.4}
TASK_WORD, TASK_PART, TASK_FIELD, TASK_BODY, TASK_DONE = 1.0, 0.6, 0.5, 0.4, 0.25
VARIANT_WEIGHT = 0.5


def ranked(df: DataFrame, *order: Column, k: int | None = 20, by: str = "query_id") -> DataFrame:
    """One-based local ranks, cut at k (Catalyst limits each group before the shuffle)."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


# weighted fields: streams and notes


def field_terms(records: DataFrame, key: str, fields: dict[str, tuple[Column, float]], tokenise=X.stream_tokens, asked: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): the largest weight of the fields that a term occurs in; with ``asked`` (term) of those terms alone."""
    def weighed(c: Column, w: float) -> Column:
        return F.transform(F.coalesce(tokenise(c), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))

    weighted = F.flatten(F.array(*(weighed(c, w) for c, w in fields.values())))
    each = records.select(key, F.explode(weighted).alias("x")).select(key, "x.term", "x.weight")
    each = each if asked is None else each.join(asked, "term", "left_semi")
    return each.groupBy(key, "term").agg(F.max("weight").alias("weight"))


def asked_terms(queries: DataFrame, tokenise=X.stream_tokens) -> DataFrame:
    """(term): all terms of a batch of queries, and their number variants, stored."""
    terms = queries.select(F.explode(tokenise(F.col("query"))).alias("term")).distinct()
    return saved(terms.union(terms.select(F.explode(X.number_variants(F.col("term"))))).distinct())


def field_match(terms: DataFrame, queries: DataFrame, key: str, tokenise=X.stream_tokens, variants: bool = True) -> DataFrame:
    """(query_id, key, score): mean over the query's terms of the weight each has in the record.

    A term that the records lack counts through its number variants, at half their weight, the best of them.
    """
    q = queries.select("query_id", F.array_distinct(tokenise(F.col("query"))).alias("want")).withColumn("n", F.size("want"))
    q = q.select("query_id", "n", F.explode("want").alias("term"))
    every = q.withColumn("spelling", F.col("term")).withColumn("factor", F.lit(1.0))
    if variants:
        vocabulary = terms.select("term").distinct()
        other = q.join(vocabulary, "term", "left_anti").select("query_id", "n", "term", F.explode(X.number_variants(F.col("term"))).alias("spelling"), F.lit(VARIANT_WEIGHT).alias("factor"))
        every = every.unionByName(other)
    hits = every.join(terms.withColumnRenamed("term", "spelling"), "spelling").groupBy("query_id", key, "term").agg(F.max(F.col("weight") * F.col("factor")).alias("w"), F.max("n").alias("n"))
    return hits.groupBy("query_id", key).agg(F.round(F.sum("w") / F.max("n"), 6).alias("score"))


def identified(records: DataFrame, queries: DataFrame, key: str, ids: list[Column], tokenise=X.stream_tokens) -> DataFrame:
    """(query_id, key): records one of whose identifiers is a term of the query."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokenise(F.col("query")))).alias("term"))
    r = records.select(key, F.explode(F.array_distinct(F.transform(F.array(*(c.cast("string") for c in ids)), F.lower))).alias("term"))
    return q.join(r.where("term IS NOT NULL AND term <> ''"), "term").select("query_id", key).distinct()


def in_window(df: DataFrame, time: str, since=None, until=None, as_of=None) -> DataFrame:
    """Inclusive window of an event time; ``as_of`` is one more upper bound. Null times don't pass a bound."""
    for bound, lower in ((since, True), (until, False), (as_of, False)):
        if bound is not None:
            df = df.where(F.col(time) >= F.lit(bound) if lower else F.col(time) <= F.lit(bound))
    return df


def search_fields(records: DataFrame, queries: DataFrame, key: str, fields, ids: list[Column], time: str, k: int = 20, tokenise=X.stream_tokens, variants: bool = True) -> DataFrame:
    """query_id, key, score, exact, rank. Queries without terms browse: every record, newest first."""
    found = field_match(saved(field_terms(records, key, fields, tokenise, asked_terms(queries, tokenise))), queries, key, tokenise, variants)
    exact = identified(records, queries, key, ids, tokenise).withColumn("exact", F.lit(True))
    browse = queries.where(F.size(tokenise(F.col("query"))) == 0).select("query_id").crossJoin(records.select(key)).withColumn("score", F.lit(0.0))
    both = found.unionByName(browse).join(exact, ["query_id", key], "full").na.fill({"score": 0.0, "exact": False})
    both = both.join(records.select(key, time), key)
    return ranked(both, F.desc("exact"), F.desc("score"), F.desc(time), F.col(key), k=k)


def note_score(df: DataFrame) -> DataFrame:
    """Notes report their score rounded to six places and no relevance; fusion reads that as fully relevant."""
    return df.withColumn("local_score", F.round("score", 6)).withColumn("relevance", F.lit(None).cast("double"))


# tasks


def task_fields(state: Column, tags: Column, contexts: Column, project: Column, priority: Column) -> Column:
    """Small-letter text of what a task is filed under."""
    plain = F.transform(contexts, lambda c: F.regexp_replace(c, "^@", ""))
    return F.lower(F.concat_ws(" ", state, tags, plain, project, priority))


def task_match(tasks: DataFrame, queries: DataFrame, body_hits: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, relevance, signals) of the tasks that match a term.

    tasks: id, title, fields (small letters), state. body_hits: (id, term) found in bodies by the store's probe.
    A term may stand inside a word, so every term is looked for in every task, once for all queries that have it. Terms are few
    per query and tasks many, so the terms are the broadcast side where their size allows; an equi-join over letter groups was ten times slower.
    """
    terms = queries.select("query_id", X.ascii_terms(F.col("query")).alias("want")).withColumn("n", F.size("want")).select("query_id", "n", F.explode("want").alias("term"))
    t = tasks.select("id", F.lower("title").alias("title"), F.coalesce("fields", F.lit("")).alias("fields"), "state")
    text = F.concat(F.col("title"), F.lit(" "), F.col("fields"))
    t = t.withColumns({"__title": X.spaced(F.col("title")), "__fields": X.spaced(F.col("fields")), "length": X.count_terms(text)})
    pairs = t.crossJoin(terms.select("term").distinct())
    pairs = pairs.withColumn("body", F.lit(False)) if body_hits is None else pairs.join(body_hits.select("id", "term", F.lit(True).alias("body")), ["id", "term"], "left").na.fill({"body": False})
    word, part, in_field = X.contains_word_of(F.col("__title"), F.col("term")), F.col("title").contains(F.col("term")), X.contains_word_of(F.col("__fields"), F.col("term"))
    in_body = F.col("body") & ~word
    pairs = pairs.withColumn("lexical", part | in_body).withColumn("field", in_field).where("lexical OR field")
    points = F.when(word, TASK_WORD).when(part, TASK_PART).otherwise(0.0) + F.when(in_field, TASK_FIELD).otherwise(0.0) + F.when(in_body, TASK_BODY).otherwise(0.0)
    per = pairs.select("term", "id", "state", "lexical", "field", points.alias("points"), X.occurrences(text, F.col("term")).alias("hits"), "length")
    per = per.join(terms, "term")
    out = per.groupBy("query_id", "id").agg(
        F.sum("points").alias("points"), F.count("*").alias("covered"), F.sum("hits").alias("hits"), F.max("length").alias("length"),
        F.max("n").alias("n"), F.max("state").alias("state"), F.max("lexical").alias("lexical"), F.max("field").alias("field"),
    )
    done = F.upper("state").isin("DONE", "CANCELLED")
    return out.select(
        "query_id", "id", F.round(F.col("points") * F.when(done, TASK_DONE).otherwise(1.0), 6).alias("score"),
        F.round(X.relevance(F.col("covered"), F.col("n"), F.col("hits"), F.col("length")), 6).alias("relevance"),
        F.array_compact(F.array(F.when(F.col("lexical"), F.lit("lexical")), F.when(F.col("field"), F.lit("field")))).alias("signals"),
    )


def priority_order(priority: Column, letters: str = "ABC") -> Column:
    at = F.instr(F.lit(letters), F.upper(priority))
    return F.when((F.length(priority) == 1) & (at > 0), at - 1).otherwise(len(letters) + 1)


def exact_ids(queries: DataFrame, pattern: str) -> DataFrame:
    """(query_id, id, mention): words of a query that are record ids, numbered as they stand."""
    words = F.transform(F.split("query", r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}<>\"'`]+|[.,;:!?()\[\]{}<>\"'`]+$", ""))
    ids = F.array_distinct(F.filter(words, lambda w: w.rlike(f"^(?:{pattern})$")))
    return queries.select("query_id", F.posexplode(ids).alias("mention", "id"))


def task_order(matched: DataFrame, exact: DataFrame, tasks: DataFrame, k: int = 20) -> DataFrame:
    """Exact ids as mentioned, then score, earliest time (none last), priority and id. tasks: id, at, priority."""
    both = matched.select("query_id", "id", "score", "relevance").join(exact, ["query_id", "id"], "full").join(tasks.select("id", "at", "priority"), "id")
    both = both.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked(both, F.col("mention").asc_nulls_last(), F.desc("score"), F.col("at").asc_nulls_last(), priority_order(F.col("priority")), F.col("id"), k=k)


def facet_exclusions(tasks: DataFrame, states=None, priorities=None, tags=None, contexts=None, exclude_states=None, exclude_tags=None, exclude_contexts=None) -> DataFrame:
    """``facet``: the first configured facet that rejects a task, null for those kept. Facets compare without case."""
    low = lambda names: [n.lower().lstrip("@") for n in names]
    some = lambda column, names: F.coalesce(F.arrays_overlap(F.transform(column, lambda t: F.regexp_replace(F.lower(t), "^@", "")), F.array(*map(F.lit, low(names)))), F.lit(False))
    among = lambda column, names: F.coalesce(F.lower(column).isin(low(names)), F.lit(False))
    rules = [
        ("states", states, lambda v: ~among("state", v)), ("priorities", priorities, lambda v: ~among("priority", v)),
        ("tags", tags, lambda v: ~some("tags", v)), ("contexts", contexts, lambda v: ~some("contexts", v)),
        ("exclude_states", exclude_states, lambda v: among("state", v)), ("exclude_tags", exclude_tags, lambda v: some("tags", v)),
        ("exclude_contexts", exclude_contexts, lambda v: some("contexts", v)),
    ]
    facet = F.coalesce(*(F.when(reject(values), F.lit(name)) for name, values, reject in rules if values), F.lit(None).cast("string"))
    return tasks.withColumn("facet", facet)


def task_request(tasks: DataFrame, project=None, entities=None, since=None, until=None) -> DataFrame:
    """A request's filter: project without case, any entity among contexts, tags and project, deadline else scheduled."""
    if project is not None:
        tasks = tasks.where(F.lower("project") == project.lower())
    if entities:
        handles = F.concat(F.transform("contexts", lambda c: F.regexp_replace(F.lower(c), "^@", "")), F.transform("tags", F.lower), F.array_compact(F.array(F.lower("project"))))
        tasks = tasks.where(F.arrays_overlap(handles, F.array(*(F.lit(e.lower().lstrip("@")) for e in entities))))
    if since is not None or until is not None:
        tasks = in_window(tasks.withColumn("__at", F.coalesce("deadline", "scheduled")), "__at", since, until).drop("__at")
    return tasks


# issues


def merge_probes(hits: DataFrame) -> DataFrame:
    """(query_id, id, probes, native, fields) from probe results (query_id, probe, id, score, field)."""
    return hits.groupBy("query_id", "id").agg(F.countDistinct("probe").alias("probes"), F.max("score").alias("native"), F.array_sort(F.collect_set("field")).alias("fields"))


def issue_order(merged: DataFrame, exact: DataFrame, issues: DataFrame, k: int = 20) -> DataFrame:
    """Exact ids as mentioned, then probes matched, best native score, priority, latest change and id."""
    both = merged.join(exact, ["query_id", "id"], "full").join(issues.select("id", "priority", "updated_at"), "id").na.fill({"probes": 0, "native": 0})
    return ranked(both, F.col("mention").asc_nulls_last(), F.desc("probes"), F.desc("native"), F.col("priority").asc_nulls_last(), F.desc("updated_at"), F.col("id"), k=k)


def issue_relevance(issues: DataFrame, queries: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(query_id, id, relevance) by how often the terms occur in id, title, description and acceptance: of the pairs
    ``found`` (query_id, id), which a search hands over; without it every query meets every issue."""
    terms = queries.select("query_id", X.ascii_terms(F.col("query"), 3).alias("want"))
    text = X.searchable(F.col("id"), F.col("title"), F.col("description"), F.col("acceptance"))
    pairs = issues.select("id", text.alias("text"), X.count_terms(text).alias("length"))
    pairs = pairs.crossJoin(terms) if found is None else pairs.join(found.select("query_id", "id").distinct(), "id").join(terms, "query_id")
    counts = F.transform("want", lambda t: X.occurrences(F.col("text"), t))
    covered, hits = F.size(F.filter(counts, lambda n: n > 0)), F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    return pairs.select("query_id", "id", F.round(X.relevance(covered, F.size("want"), hits, F.col("length")), 6).alias("relevance"))


def issue_fingerprint(store: Column, key: Column, updated: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", store, key, updated), 256), 1, 16)


def issue_filter(issues: DataFrame, statuses=None, types=None, labels=None, entities=None) -> DataFrame:
    """Any of each list; entities over labels, parent and sessions, without case."""
    if statuses:
        issues = issues.where(F.lower("status").isin([s.lower() for s in statuses]))
    if types:
        issues = issues.where(F.lower("type").isin([s.lower() for s in types]))
    if labels:
        issues = issues.where(F.arrays_overlap(F.transform("labels", F.lower), F.array(*(F.lit(x.lower()) for x in labels))))
    if entities:
        handles = F.transform(F.concat("labels", F.array_compact(F.array("parent_id")), F.coalesce("sessions", F.array().cast("array<string>"))), F.lower)
        issues = issues.where(F.arrays_overlap(handles, F.array(*(F.lit(x.lower()) for x in entities))))
    return issues


def scope_total(counts: DataFrame, statuses: list[str] | None) -> DataFrame:
    """How many records a status filter leaves in scope, from counts by status."""
    kept = F.lit(True) if not statuses else F.col("status").isin(statuses)
    return counts.agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("total"))


def match_signals(exact: Column, fields: Column) -> Column:
    """Why a record surfaced: title and description are lexical, other fields are field matches."""
    lexical = F.arrays_overlap(fields, F.array(F.lit("title"), F.lit("description")))
    field = F.exists(fields, lambda f: ~f.isin("title", "description"))
    return F.array_compact(F.array(F.when(exact, F.lit("exact_identifier")), F.when(lexical, F.lit("lexical")), F.when(field, F.lit("field"))))


def query_mode(exact: Column, terms: Column, filters: Column) -> Column:
    """Label of how a source answered."""
    return F.when(exact, F.lit("exact")).when(terms, F.lit("lexical")).when(filters, F.lit("temporal")).otherwise(F.lit("structured"))


# mail


def header_relevance(threads: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, covered, relevance) over sender and subject, where a term occurs; else both are 0.

    threads: id, sender, subject. Terms meet header words in an equi-join: no query is held against every thread.
    """
    q = queries.select("query_id", X.content_terms(F.col("query")).alias("want")).withColumn("n", F.size("want")).select("query_id", "n", F.explode("want").alias("term"))
    header = threads.select("id", X.tokens(F.concat_ws(" ", "sender", "subject")).alias("have")).withColumn("length", F.size("have"))
    words = header.select("id", "length", F.explode("have").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    found = words.join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("covered"), F.sum("tf").alias("hits"), F.max("n").alias("n"), F.max("length").alias("length"))
    return found.select("query_id", "id", "covered", F.round(X.relevance(F.col("covered"), F.col("n"), F.col("hits"), F.col("length")), 6).alias("relevance"))


def date_precision(text: Column) -> tuple[Column, Column]:
    """(first instant, last instant) that a thread's date text may mean: to the second, the minute or the day."""
    second = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    minute = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    start = F.coalesce(second, minute, day)
    width = F.when(second.isNotNull(), 0).when(minute.isNotNull(), 59).when(day.isNotNull(), 86399)
    return start, F.timestamp_seconds(F.unix_seconds(start) + width)


def date_filter(threads: DataFrame, date: str, since=None, until=None) -> DataFrame:
    """Adds ``verdict``: dropped only if certainly outside; else inside, uncertain, or unknown for unreadable dates."""
    start, stop = date_precision(F.col(date))
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    outside = (stop < lo) | (start > hi)
    inside = (F.lit(since is None) | (start >= lo)) & (F.lit(until is None) | (stop <= hi))
    verdict = F.when(start.isNull(), F.lit("unknown")).when(F.coalesce(outside, F.lit(False)), F.lit("dropped")).when(inside, F.lit("inside")).otherwise(F.lit("uncertain"))
    return threads.withColumn("verdict", verdict)


def mail_flags(labels: Column, sender: Column) -> dict[str, Column]:
    """Flags of a thread; a reply may be due for unread, not automated mail in the inbox."""
    has = lambda name: F.array_contains(labels, name)
    automated = sender.rlike("(?i)no-?reply|do-?not-?reply|notifications?@|mailer-daemon") | F.arrays_overlap(labels, F.array(F.lit("CATEGORY_PROMOTIONS"), F.lit("CATEGORY_UPDATES"), F.lit("CATEGORY_SOCIAL"), F.lit("CATEGORY_FORUMS")))
    return {"inbox": has("INBOX"), "unread": has("UNREAD"), "starred": has("STARRED"), "automated": automated, "needs_reply_hint": has("INBOX") & has("UNREAD") & ~automated}


def promote_exact(threads: DataFrame, exact: Column, position: str = "position", k: int = 20) -> DataFrame:
    """The thread that was named first, the others as the store returned them."""
    return ranked(threads.withColumn("exact", exact), F.desc("exact"), F.col(position), k=k)


# vectors


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def vector_relevance(a: Column, b: Column) -> Column:
    """Cosine between 0 and 1, to four places."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b))), 4)


def vector_search(items: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, vec_id, relevance, rank. queries: (query_id, vector), a batch; its size decides whether it is broadcast."""
    pairs = items.select("vec_id", "embedding").crossJoin(queries.select("query_id", "vector"))
    return ranked(pairs.select("query_id", "vec_id", vector_relevance(F.col("embedding"), F.col("vector")).alias("relevance")), F.desc("relevance"), F.col("vec_id"), k=k)


def span_relevance(items: DataFrame, queries: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """(query_id, id, relevance) where a term occurs: lexical relevance of title and body, for modes whose native score isn't a
    similarity. Terms meet words in an equi-join."""
    q = queries.select("query_id", X.content_terms(F.col("query")).alias("want")).withColumn("n", F.size("want")).select("query_id", "n", F.explode("want").alias("term"))
    have = items.select("id", X.tokens(F.concat_ws(" ", title, body)).alias("have")).withColumn("length", F.size("have"))
    words = have.select("id", "length", F.explode("have").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    found = words.join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("covered"), F.sum("tf").alias("hits"), F.max("n").alias("n"), F.max("length").alias("length"))
    return found.select("query_id", "id", F.round(X.relevance(F.col("covered"), F.col("n"), F.col("hits"), F.col("length")), 6).alias("relevance"))


def span_header(snippet: Column) -> dict[str, Column]:
    """``@@ -12,4 @@`` before a snippet: first line, number of lines, and the text after it."""
    head = r"\A@{2} -([0-9]+),([0-9]+) @{2}[^\n]*\n?"
    return {"line": F.regexp_extract(snippet, head, 1).try_cast("int"), "lines": F.regexp_extract(snippet, head, 2).try_cast("int"), "body": F.regexp_replace(snippet, head, "")}


def bounded_trace(contributions: Column, queries: Column, most: int = 8) -> dict[str, Column]:
    """The first rank contributions and distinct expanded queries of a semantic hit."""
    return {"contributions": F.slice(contributions, 1, most), "expanded": F.slice(F.array_distinct(F.filter(queries, lambda q: q != "")), 1, most)}
