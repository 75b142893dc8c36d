"""Lexical retrieval over chunks: inverted index, BM25 with coverage, aboutness, identifiers, local order.

All operators work on a batch of queries at once. Texts are tokenised once, into postings that carry their chunk's
length; the other tables of an index are counted from those. A stored index has its postings ranged and sorted by term, and a
search reads terms, frequencies and lengths of it, never a text. Corpus counts (number of chunks, document frequencies, mean length) are
over all chunks: a filter decides who is scored, never what a term weighs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwell.functions import text as X
from braidwell.functions.markdown import excerpt_udf
from braidwell.schema import CANDIDATE, CLASS_IDENTIFIER, CLASS_NATURAL, conform
from braidwell.shared import saved

K1, B = 1.2, 0.75
VARIANT_WEIGHT = 0.5


@dataclass
class Index:
    postings: DataFrame  # term, chunk_id, length (of the chunk), tf; a chunk without a token has one row without a term
    lengths: DataFrame  # chunk_id, length
    vocabulary: DataFrame  # term, df
    stats: DataFrame  # n, avg_len: one row

    def saved(self) -> Index:
        """The index as tables of the shared folder, for several searches."""
        return index_of(saved(laid_out(self.postings)), saved)


def laid_out(postings: DataFrame) -> DataFrame:
    """Postings as they are stored: by term, in partitions of equal size whatever terms are frequent, sorted. Hashed and not ranged:
    ranges are found by computing all postings once more."""
    return postings.hint("rebalance", "term").sortWithinPartitions("term", "chunk_id")


def index_of(postings: DataFrame, keep=lambda df: df) -> Index:
    """An index from its postings; ``keep`` stores what searches read again and again."""
    lengths = postings.groupBy("chunk_id").agg(F.first("length").alias("length"))
    held = postings.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings, lengths, keep(held), keep(lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg_len"))))


def build_index(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> Index:
    """Texts are shuffled, once and by chunk, so that their tokens, which are many more rows, are counted where they are made."""
    spark = chunks.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = chunks.select(F.col(key).alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition(n, "chunk_id")
    tokenised = texts.select("chunk_id", X.tokens(F.col("text")).alias("tokens"))
    rows = tokenised.select("chunk_id", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term"))
    return index_of(rows.groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf")))


def index_for(chunks: DataFrame, queries: DataFrame) -> Index:
    """The part of an index that a batch of queries reads, stored: postings of their terms and of those terms' variants, and a row
    without a term for every chunk. Counts are those of the whole index: all texts are read, once, and nothing else is shuffled."""
    terms = query_terms(queries).select("term").distinct()
    asked = saved(terms.union(terms.select(F.explode(X.number_variants(F.col("term"))))).distinct().withColumn("asked", F.lit(True)))
    tokenised = chunks.select("chunk_id", X.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    every = tokenised.select("chunk_id", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term"))
    rows = every.join(asked, "term", "left").where("asked OR term IS NULL")
    return index_of(saved(rows.groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf"))), saved)


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (n - df + 1/2) / (df + 1/2)), as one fraction."""
    return F.log((n + 1) / (df + 0.5))


def analysed(queries: DataFrame) -> DataFrame:
    """Adds query_class ('' without words, identifier or natural language) and stable_identifiers."""
    stable = X.stable_identifiers(F.coalesce("query", F.lit("")))
    words = F.regexp_count(F.coalesce("query", F.lit("")), F.lit(r"[\p{L}\p{N}]+"))
    kind = F.when(words == 0, F.lit("")).when((words == 1) | (F.size(stable) > 0), F.lit(CLASS_IDENTIFIER)).otherwise(F.lit(CLASS_NATURAL))
    return queries.withColumns({"query_class": kind, "stable_identifiers": stable})


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, content, normalized): distinct terms; content ones count for coverage. Function words have no content
    unless they stand in double quotes, or nothing else would be left."""
    inside = lambda s, i: F.transform(X.tokens(s), lambda t: F.struct(t.alias("term"), ((i % 2 == 1) | ~t.isin(*X.FUNCTION_WORDS)).alias("content")))
    q = queries.select("query_id", F.flatten(F.transform(F.split("query", '"'), inside)).alias("raw"))
    q = q.withColumn("kept", F.filter("raw", lambda t: t["content"]))
    q = q.withColumn("normalized", (F.size("kept") > 0) & (F.size("kept") < F.size("raw")))
    q = q.select("query_id", "normalized", F.col("kept.term").alias("kept"), F.explode(F.array_distinct(F.col("raw.term"))).alias("term"))
    return q.select("query_id", "term", "normalized", (~F.col("normalized") | F.array_contains("kept", F.col("term"))).alias("content"))


def resolve_variants(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, term, spelling): number variants held by the vocabulary, for terms that it lacks."""
    open_ = terms.where("content").where(~F.col("term").isin(*X.FUNCTION_WORDS)).join(vocabulary.select("term"), "term", "left_anti")
    forms = open_.select("query_id", "term", F.explode(X.number_variants(F.col("term"))).alias("spelling"))
    return forms.join(vocabulary.select(F.col("term").alias("spelling")), "spelling", "left_semi").select("query_id", "term", "spelling")


def spellings(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, term, content, normalized, spelling, weight, scores).

    Function words score only where some content term of their query can be reached.
    """
    own = terms.withColumn("spelling", F.col("term")).withColumn("weight", F.lit(1.0))
    more = resolve_variants(terms, vocabulary).join(terms, ["query_id", "term"]).withColumn("weight", F.lit(VARIANT_WEIGHT))
    every = own.unionByName(more)
    held = vocabulary.select(F.col("term").alias("spelling"), F.lit(True).alias("held"))
    every = every.join(held, "spelling", "left")
    reached = F.max(F.coalesce("held", F.lit(False)) & F.col("content")).over(Window.partitionBy("query_id"))
    return every.withColumn("scores", F.col("content") | reached).drop("held")


def score(index: Index, spelled: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, raw, bm25, covered, hits) of every chunk that holds a spelling and is allowed.

    Spellings with their document frequencies are a small table of known size: postings meet it in a broadcast
    join while it is small and are shuffled by term beyond that. Variants of one term are summed first, so that
    terms are counted without a distinct aggregate.
    """
    weighed = saved(spelled.join(index.vocabulary.select(F.col("term").alias("spelling"), "df"), "spelling"))
    hits = index.postings.withColumnRenamed("term", "spelling").join(weighed, "spelling")
    if allowed is not None:
        hits = hits.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    hits = hits.crossJoin(F.broadcast(index.stats))  # stats: one row
    part = F.col("weight") * idf(F.col("df"), F.col("n")) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_len")))
    hits = hits.select("query_id", "chunk_id", "term", "content", "scores", "length", "tf", "weight", F.when(F.col("scores"), part).otherwise(0.0).alias("part"))
    keys = ["query_id", "chunk_id", "term", "content", "scores", "length"]
    variants = hits.where("weight < 1").groupBy(keys).agg(F.sum("tf").alias("tf"), F.sum("part").alias("part"))
    terms = hits.where("weight = 1").select(*keys, "tf", "part").unionByName(variants)
    return terms.groupBy("query_id", "chunk_id").agg(
        F.sum("part").alias("raw"), F.count_if("content").alias("covered"), F.sum(F.when(F.col("content"), F.col("tf")).otherwise(0)).alias("hits"),
        F.max("length").alias("length"), F.max(F.when(F.col("scores"), 1).otherwise(0)).alias("scored"),
    ).withColumn("bm25", F.round("raw", 6))


def search(index: Index, queries: DataFrame, k: int = 20, allowed: DataFrame | None = None, cited: DataFrame | None = None) -> DataFrame:
    """Ranked hits: query_id, chunk_id, bm25, score (times coverage), relevance, rank.

    ``cited``: (chunk_id, term, tf) of quoted text; it is taken off hits and length where relevance is judged.
    """
    terms = saved(query_terms(queries))
    vocabulary = index.vocabulary
    if allowed is not None:
        vocabulary = index.postings.where("term IS NOT NULL").join(allowed.select("chunk_id"), "chunk_id", "left_semi").select("term").distinct()
    spelled = saved(spellings(terms, vocabulary))
    groups = terms.groupBy("query_id").agg(F.count_if("content").alias("groups"), F.max("normalized").alias("normalized"))
    found = score(index, spelled, allowed).join(groups, "query_id").where("scored = 1")
    found = found.where(~F.col("normalized") | (F.col("covered") >= F.least("groups", F.lit(2))))
    found = found.withColumn("score", F.round(F.col("raw") * F.when(F.col("groups") > 0, F.col("covered") / F.col("groups")).otherwise(1.0), 6))
    if cited is None:
        found = found.withColumn("relevance", F.round(X.relevance(F.col("covered"), F.col("groups"), F.col("hits"), F.col("length")), 6))
    else:
        found = found.join(aboutness(index, spelled, groups, cited), ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def aboutness(index: Index, spelled: DataFrame, groups: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, chunk_id, relevance) with quoted text discounted; a chunk that is all quotation is about nothing."""
    own = spelled.where("content").join(index.postings.withColumnRenamed("term", "spelling"), "spelling").select("query_id", "chunk_id", "term", "tf")
    off = spelled.where("content").join(cited.withColumnRenamed("term", "spelling"), "spelling").select("query_id", "chunk_id", "term", (-F.col("tf")).alias("tf"))
    per_term = own.unionByName(off).groupBy("query_id", "chunk_id", "term").agg(F.sum("tf").alias("n")).where("n > 0")
    counted = per_term.groupBy("query_id", "chunk_id").agg(F.count("*").alias("covered"), F.sum("n").alias("hits"))
    quoted = cited.groupBy("chunk_id").agg(F.sum("tf").alias("quoted"))
    sized = index.lengths.join(quoted, "chunk_id", "left").select("chunk_id", "length", (F.col("length") - F.coalesce("quoted", F.lit(0))).alias("left"))
    every = own.select("query_id", "chunk_id").distinct().join(counted, ["query_id", "chunk_id"], "left").join(sized, "chunk_id").join(groups, "query_id")
    value = X.relevance(F.coalesce("covered", F.lit(0)), F.col("groups"), F.coalesce("hits", F.lit(0)), F.col("left"))
    return every.select("query_id", "chunk_id", F.round(F.when(F.col("left") <= 0, 0.0).otherwise(value), 6).alias("relevance"))


def identifier_matches(queries: DataFrame, idents: DataFrame) -> DataFrame:
    """(query_id, chunk_id, alias): identifiers (token sequences) that stand in the query, token by token.

    Identifiers are cut to their first token and matched by it, so this is a hash join and not a nested loop.
    idents: chunk_id, ident, alias.
    """
    q = queries.select("query_id", X.tokens("query").alias("tokens")).withColumn("first", F.explode(F.array_distinct("tokens")))
    i = idents.select("chunk_id", "alias", F.split("ident", " ").alias("want")).withColumn("first", F.get("want", F.lit(0)))
    return q.join(i, "first").where(X.contains_sequence(F.col("tokens"), F.col("want"))).groupBy("query_id", "chunk_id").agg(F.max("alias").alias("alias"))


def local_order(found: DataFrame, exact: DataFrame, k: int = 20) -> DataFrame:
    """Exact matches first, then score, path and ordinal; exact chunks that no term found come in with score 0."""
    both = found.select("query_id", "chunk_id", "score", "relevance").join(exact.select("query_id", "chunk_id", F.lit(True).alias("exact")), ["query_id", "chunk_id"], "full")
    both = both.select("query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"), "relevance", F.coalesce("exact", F.lit(False)).alias("exact"))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_filter(docs: DataFrame, since=None, until=None, as_of=None, project=None, time: str = "mod_time", of: str = "project") -> DataFrame:
    """Inclusive bounds of the modification time, ``as_of`` an upper one, project without case."""
    if since is not None:
        docs = docs.where(F.col(time) >= F.lit(since))
    for bound in (until, as_of):
        if bound is not None:
            docs = docs.where(F.col(time) <= F.lit(bound))
    return docs if project is None else docs.where(F.lower(of) == project.lower())


def entity_filter(index: Index, entities: list[str]) -> DataFrame:
    """chunk_id of the chunks that hold every token of every entity."""
    import re

    want = sorted({t for e in entities for t in re.split(r"[^\w]+|_", e.lower()) if t})
    held = index.postings.where(F.col("term").isin(want)).groupBy("chunk_id").agg(F.countDistinct("term").alias("n"))
    return held.where(F.col("n") == len(want)).select("chunk_id")


def candidates(ranked: DataFrame, chunks: DataFrame, source_uid: str, source_id: str, terms: DataFrame | None = None) -> DataFrame:
    """Hits as candidates. Texts are joined after the cut to k, so excerpts are made for results only: with ``terms``
    (``query_terms``) the lines that hold most content terms of the query, else, or where none does, the head of the text.

    chunks: chunk_id, record_id, title, text, and optionally event_time, revision, sensitivity.
    """
    have = set(chunks.columns)
    col = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    joined = ranked.join(chunks, "chunk_id").withColumn("__matched", F.lit(None).cast("string"))
    if terms is not None:
        wanted = terms.where("content").groupBy("query_id").agg(F.collect_set("term").alias("__terms"))
        joined = joined.join(wanted, "query_id", "left").withColumn("__matched", excerpt_udf(F.col("text"), F.col("__terms")))
    return joined.select(
        "query_id", F.lit(source_uid).alias("source_uid"), F.lit(source_id).alias("source_id"),
        F.concat(F.lit(source_id + ":"), F.col("chunk_id").cast("string")).alias("candidate_id"),
        F.col("record_id").cast("string").alias("source_record_id"), F.col("chunk_id").cast("string").alias("local"),
        F.array().cast("array<string>").alias("derived_from"), F.lit("document").alias("record_type"),
        "title", F.coalesce("__matched", X.preview(F.col("text"))).alias("excerpt"), F.when(F.col("__matched").isNull(), "preview").otherwise("matched").alias("excerpt_kind"),
        F.col("rank").alias("local_rank"), F.col("score").alias("local_score"), "relevance",
        F.array(F.lit("lexical")).alias("match_signals"), col("event_time", "timestamp").alias("event_time"),
        col("revision", "string").alias("source_revision"), F.coalesce(col("sensitivity", "int"), F.lit(1)).alias("sensitivity"),
        X.fingerprint(F.col("text")).alias("content_fingerprint"),
    )


def of_types(candidates: DataFrame, record_types: list[str] | None) -> DataFrame:
    """Candidates of the record types asked for; all where none is."""
    return candidates.where(F.col("record_type").isin(list(record_types))) if record_types else candidates


def record_candidates(found: DataFrame, records: DataFrame, source_uid: str, source_id: str, record_type: str, title: Column, excerpt: Column, by: str = "id", **more: Column) -> DataFrame:
    """Ranked records (query_id, ``by``, rank, and where there are: score, relevance, signals, mention) as candidates of a
    source whose records aren't cut into chunks, so record, candidate and locator are one id. ``more``: further columns of
    a candidate, from ``records``."""
    have = lambda name, default: F.col(name) if name in found.columns else default
    exact = have("mention", F.lit(None)).isNotNull() | F.coalesce(have("exact", F.lit(False)), F.lit(False))
    signals = F.coalesce(have("signals", F.array(F.lit("lexical"))), F.array().cast("array<string>"))
    ranks = found.select(
        "query_id", F.col(by).alias("__id"), F.col("rank").alias("local_rank"), have("score", F.lit(None)).cast("double").alias("local_score"), have("relevance", F.lit(None)).cast("double").alias("relevance"),
        F.concat(F.when(exact, F.array(F.lit("exact_identifier"))).otherwise(F.array().cast("array<string>")), signals).alias("match_signals"),
    )
    local = F.col(by).cast("string")
    shown = records.select(F.col(by).alias("__id"), local.alias("local"), title.alias("title"), X.bounded(excerpt, 400).alias("excerpt"), *(c.alias(n) for n, c in more.items()))
    out = ranks.join(shown, "__id").withColumns({"source_uid": F.lit(source_uid), "source_id": F.lit(source_id), "candidate_id": F.col("local"), "source_record_id": F.col("local"), "record_type": F.lit(record_type), "derived_from": F.array().cast("array<string>"), "excerpt_kind": F.lit("preview")})
    return conform(out, CANDIDATE)


def task_candidates(found: DataFrame, tasks: DataFrame, source_uid: str, source_id: str) -> DataFrame:
    """tasks: id, title, headline, notes, at, closed, and optionally revision, sensitivity, metadata."""
    first = F.when(F.size("notes") > 0, F.concat(F.lit(" \u2014 "), F.get("notes", F.lit(0)))).otherwise("")
    own = {n: F.col(c) for n, c in {"source_revision": "revision", "sensitivity": "sensitivity", "metadata": "metadata"}.items() if c in tasks.columns}
    text = F.concat(F.when(F.coalesce("headline", F.lit("")) != "", F.col("headline")).otherwise(F.col("title")), first)
    return record_candidates(found, tasks, source_uid, source_id, "task", F.col("title"), text, event_time=F.col("at"), valid_to=F.col("closed"), **own)


def issue_candidates(found: DataFrame, issues: DataFrame, source_uid: str, source_id: str, store: str) -> DataFrame:
    """issues: id, title, description, created_at, updated_at, closed_at. Two sources that read one store hand over one
    fingerprint for one issue, so it is one piece of evidence."""
    from braidwell.operators.records import issue_fingerprint

    text = F.concat_ws(" \u2014 ", F.col("title"), F.when(F.coalesce("description", F.lit("")) != "", F.col("description")))
    return record_candidates(found, issues, source_uid, source_id, "task", F.col("title"), text, event_time=F.col("updated_at"), valid_from=F.col("created_at"), valid_to=F.col("closed_at"), content_fingerprint=issue_fingerprint(F.lit(store), F.col("id").cast("string"), F.col("updated_at").cast("string")))


def thread_candidates(found: DataFrame, threads: DataFrame, source_uid: str, source_id: str) -> DataFrame:
    """threads: id, subject, sender, at (null where the store's date can't be read)."""
    text = F.concat_ws(" \u2014 ", "sender", "subject")
    return record_candidates(found, threads, source_uid, source_id, "message", F.col("subject"), text, event_time=F.col("at"))


def semantic_candidates(found: DataFrame, hits: DataFrame, source_uid: str, source_id: str) -> DataFrame:
    """hits: id, file, title, body (the matched span). They are documents with the excerpt that matched."""
    named = F.create_map(F.lit("path"), F.col("file"))
    signals = found.withColumn("signals", F.array(F.lit("semantic")))
    return record_candidates(signals, hits, source_uid, source_id, "document", F.col("title"), F.col("body"), metadata=named).withColumn("excerpt_kind", F.lit("matched"))
