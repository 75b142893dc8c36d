"""Fusion of ranked lists: lineage groups, link keys, units and clusters, capped corroboration, promotion.

Scores of different sources are never compared; only ranks, priors and the sources' relevance enter. Groups are
made relationally over all queries at once. Clustering needs a fixed point over a query's pool, which the
per-source limits keep small (sources x limit), so it is done query by query, on Arrow batches that hold many of them;
``components`` is the relational version for pools of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidwell.functions import text as X
from braidwell.operators.lineage import independent, parent_edges, parents_of, self_root, source_derivation, walked
from braidwell.schema import CLASS_IDENTIFIER, CLASS_NATURAL, CORROBORATION_CAP, LIMIT, RANK_CONSTANT, RELEVANCE_FLOOR, RESULT, SUPPRESSION, ddl
from braidwell.shared import saved



def effective_relevance(relevance: Column) -> Column:
    """Null counts as 1; NaN and negatives as 0; more than 1 as 1."""
    return F.when(relevance.isNull(), 1.0).when(F.isnan(relevance) | (relevance < 0), 0.0).when(relevance > 1, 1.0).otherwise(relevance)


def floor_relevance(relevance: Column) -> Column:
    """As above, but what isn't finite counts as 1: a broken value must not hide a result."""
    finite = ~F.isnan(relevance) & (F.abs(relevance) < float("inf"))
    return F.when(relevance.isNull() | ~finite, 1.0).otherwise(effective_relevance(relevance))


def prior(base: Column, intents: Column, query_class: Column) -> Column:
    """A source's prior: that of the query's class where one is in force; between 0.5 and 2."""
    chosen = F.coalesce(F.when(query_class != "", F.try_element_at(intents, query_class)), base, F.lit(1.0))
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), chosen))


def rank_score(prior_: Column, relevance: Column, rank: Column, constant: float = RANK_CONSTANT) -> Column:
    return prior_ * relevance / (constant + rank)


def best_by_source(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Best local rank of each source in a group, with the relevance of that same candidate."""
    order = Window.partitionBy(*by, "source_uid").orderBy("local_rank", "local", "candidate_id")
    return candidates.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def lineage_groups(candidates: DataFrame, sources: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query and root: score (the maximum over sources), flags, primary candidate, link keys (their kind first)
    and lineage (that of the least deep candidate)."""
    edges, _ = parent_edges(candidates, sources)
    me = self_root(F.col("source_uid"), F.col("local"))
    pool = walked(candidates.withColumn("node", me), parents_of(edges, ["query_id"]), ["query_id"])  # all children are candidates
    s = sources.select("source_uid", F.col("base_prior"), F.col("intent_priors"), F.col("location"), "derives_from", F.col("source_id").alias("__sid"))
    pool = source_derivation(pool, sources).join(F.broadcast(s.drop("derives_from")), "source_uid", "left")  # configured sources: a list in a file
    pool = pool.join(queries.select("query_id", "query_class", "stable_identifiers", "mode", "suppress_lineages", "limit"), "query_id")
    p = prior(F.col("base_prior"), F.col("intent_priors"), F.coalesce("query_class", F.lit("")))
    pool = pool.withColumn("prior", p).withColumn("pool_size", F.count("*").over(Window.partitionBy("query_id", "source_uid")).cast("int"))
    rel = effective_relevance(F.col("relevance"))
    in_source = Window.partitionBy("query_id", "root", "source_uid").orderBy("local_rank", "local", "candidate_id")
    pool = pool.withColumn("__score", F.when(F.row_number().over(in_source) == 1, rank_score(F.col("prior"), rel, F.col("local_rank"))))
    exact = F.coalesce(F.array_contains("match_signals", "exact_identifier"), F.lit(False))
    named = F.array("candidate_id", "source_record_id", "local", "title", F.try_element_at("metadata", F.lit("name")), F.try_element_at("metadata", F.lit("path")), F.try_element_at("metadata", F.lit("relative_path")))
    named = F.filter(F.transform(named, lambda x: F.split(F.lower(F.trim(x)), "#")[0]), lambda x: x.isNotNull() & (x != ""))
    named = F.concat(named, F.transform(named, lambda x: F.regexp_replace(x, r"^.*[/\\]", "")))
    identity = F.coalesce(F.arrays_overlap(named, "stable_identifiers"), F.lit(False))
    strict = lambda *parts: F.concat_ws("\0", *parts)
    key = lambda ok, kind, *parts: F.when(ok, strict(F.lit(kind), *parts))
    some = lambda *cols: [F.coalesce(c, F.lit("")) != "" for c in cols]
    record, printed, revision = (F.col(c) for c in ("source_record_id", "content_fingerprint", "source_revision"))
    has_record, has_print, has_revision, has_place, has_entity = some(record, printed, revision, F.col("location"), F.trim(F.col("entity_id")))
    entity = F.coalesce(F.when(F.trim(F.col("entity_type")) != "", F.trim(F.col("entity_type"))), F.col("record_type"))
    names = F.filter(F.transform(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))), X.matchable_name), lambda x: x.isNotNull())
    keys = F.concat(
        F.array(
            key(has_record, "record", F.col("source_uid"), record),
            key(has_print, "fingerprint", F.col("record_type"), printed),
            key(has_record & has_place, "location-record", F.col("location"), F.col("record_type"), record),
            key(has_record & has_print & has_revision, "view", F.col("record_type"), record, printed, revision),
            key(has_entity, "entity", entity, F.trim(F.col("entity_id"))),
        ),
        F.transform(names, lambda x: F.concat(F.lit("name\0"), F.coalesce(F.col("record_type"), F.lit("")), F.lit("\0"), x)),
    )
    primary = F.struct("source_uid", F.coalesce("source_id", "__sid").alias("source_id"), *_PRIMARY[2:])
    first = F.min_by(primary, F.struct(-F.col("prior"), F.col("local_rank"), F.col("local"), F.col("candidate_id")))
    derived = (F.size("ancestors") > 0) | (F.coalesce("source_derives_from", F.lit("")) != "")
    seen = F.coalesce((F.col("mode") == "pre_reply") & F.array_contains("suppress_lineages", F.col("root")), F.lit(False))
    groups = pool.groupBy("query_id", "root").agg(
        F.first("query_class").alias("query_class"), F.max(seen).alias("seen"),
        F.coalesce(F.first("limit"), F.lit(0)).alias("limit"), F.max("__score").alias("score"), F.max(exact).alias("exact"),
        F.max(exact & F.coalesce(F.array_contains("match_signals", "alias"), F.lit(False))).alias("exact_alias"), F.max(exact & identity).alias("exact_identity"),
        F.max(F.coalesce(F.size("stable_identifiers"), F.lit(0)) > 0).alias("stable"), F.count("*").cast("int").alias("count"), F.max(floor_relevance(F.col("relevance"))).alias("floor_relevance"),
        F.array_distinct(F.flatten(F.collect_list(F.filter(keys, lambda k: k.isNotNull())))).alias("keys"),
        F.min(F.struct("depth", "ancestors", "source_derives_from")).alias("lineage"), F.bool_and(derived).alias("derivative"),
        F.collect_set(F.when(has_print, strict(F.col("source_uid"), printed))).alias("prints"), F.array_sort(F.collect_set("source_id")).alias("sources"), first.alias("primary"),
    )
    return groups.select("*", "lineage.depth", "lineage.ancestors", "lineage.source_derives_from", *(F.col(f"primary.{c}").alias(f"primary_{c}") for c in _PRIMARY)).drop("lineage", "primary")


#: What is told of a candidate that stands for its group.
_PRIMARY = ("source_uid", "source_id", "local", "candidate_id", "source_record_id", "record_type", "title", "excerpt", "excerpt_kind", "local_rank", "relevance", "pool_size", "prior")
_LINKS = {"record": ("dup", "same"), "fingerprint": ("dup",), "location-record": ("dup",), "view": ("dup", "same", "view"), "entity": ("same",), "name": ("same",)}


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def clusters_of(groups: list[dict], cap: float = CORROBORATION_CAP) -> list[dict]:
    """Clusters of one query's groups, which come by root. Groups that share a key are linked by the relations of its kind."""
    sets = {r: _Sets(len(groups)) for r in ("dup", "same", "view")}
    first: dict[str, int] = {}
    for i, g in enumerate(groups):
        for k in g["keys"]:
            j = first.setdefault(k, i)
            if j != i:
                for relation in _LINKS[k.partition("\0")[0]]:
                    sets[relation].union(j, i)

    def split(members: list[int], relation: str) -> list[list[dict]]:
        if len(members) == 1:
            return [[groups[members[0]]]]
        out: dict[int, list[dict]] = {}
        for i in members:
            out.setdefault(sets[relation].find(i), []).append(groups[i])
        return list(out.values())

    strength = lambda g: (-g["score"], g["root"])
    by_cluster: dict[int, list[int]] = {}
    for i in range(len(groups)):
        by_cluster.setdefault(sets["same"].find(i), []).append(i)
    out = []
    for members in by_cluster.values():
        units = [{"groups": unit, "score": max(0.0, *(g["score"] for g in unit)), "root": unit[0]["root"], "derivative": all(g["derivative"] for g in unit)} for unit in split(members, "dup")]
        units.sort(key=strength)
        counted, total, independent_, corroborating, sources = [], 0.0, 0, 0, set()
        for u in sorted(units, key=lambda u: (u["derivative"], -u["score"], u["root"])):
            got = independent(counted + u["groups"])
            if got > independent_:
                counted, independent_, corroborating, total = counted + u["groups"], got, corroborating + 1, total + u["score"]
                sources.update(s for g in u["groups"] for s in g["sources"])
        most = cap * units[0]["score"]
        basis = min(units[0]["groups"], key=strength)
        shown, p = basis, basis["primary"]
        if p["record_type"] == "document" and p["excerpt_kind"] == "preview" and p["source_uid"] and p["source_record_id"]:
            same = [g for g in units[0]["groups"] if g["primary"]["record_type"] == "document" and g["primary"]["excerpt_kind"] == "matched" and (g["primary"]["source_uid"], g["primary"]["source_record_id"]) == (p["source_uid"], p["source_record_id"])]
            shown = min(same, key=strength, default=basis)
        views = [sorted(v, key=strength) for v in split(members, "view")]
        own = [groups[i] for i in members]
        out.append(
            {
                "root": basis["root"], "score": min(total, most), "cap_applied": total > most, "independent": corroborating, "sources": sorted(sources),
                "primary": shown["primary"], "basis": p, "exact": any(g["exact"] for g in own), "alias": any(g["exact_alias"] for g in own),
                "identity": any(g["exact_identity"] for g in own), "views": sorted(views, key=lambda v: v[0]["root"]), "count": sum(g["count"] for g in own),
                "floor": max(g["floor_relevance"] for g in own), "prints": {f for g in own for f in g["prints"]}, "members": [g["root"] for g in own],
            }
        )
    return out


def promotable(c: dict, query_class: str, stable: bool) -> bool:
    """Whether an exact match goes first: by alias always, else by the query's class."""
    if not c["exact"] or c["alias"]:
        return c["exact"]
    if query_class == CLASS_NATURAL:
        return False
    return not stable or c["identity"] if query_class == CLASS_IDENTIFIER else True


def ordered(clusters: list[dict], query_class: str, stable: bool) -> list[dict]:
    """Promoted first, then score; between zero scores the local rank; then locator, candidate and root."""

    def place(c: dict):
        b = c["basis"]
        return (not promotable(c, query_class, stable), -c["score"], b["local_rank"] if c["score"] == 0 else 0, f"{b['source_id']}:{b['local']}", b["candidate_id"] or "", c["root"])

    return sorted(clusters, key=place)


def select_results(clusters: list[dict], floor: float, limit: int, per_source: int = 0):
    """(shown, suppressions, dropped) of ordered clusters.

    Each cluster is withheld for one reason at most: below the floor (never exact ones), all views seen by
    the caller before, or a fingerprint that a kept cluster of the same source already shows. If that leaves nothing,
    the floor stands down. Beyond ``per_source`` results of a source go to the tail; the limit comes last.
    """

    def withhold(least: float):
        kept, held, shown = [], [], set()
        for c in clusters:
            if least > 0 and not c["exact"] and c["floor"] < least:
                held.append(("relevance_floor", c))
            elif all(any(g["seen"] for g in view) for view in c["views"]):
                held.append(("lineage_seen", c))
            elif not shown.isdisjoint(c["prints"]):
                held.append(("duplicate", c))
            else:
                shown.update(c["prints"])
                kept.append(c)
        return kept, held

    kept, held = withhold(floor)
    if not kept and floor > 0:
        kept, held = withhold(0)
    head, tail, seen = [], [], {}
    for c in kept:
        uid = c["primary"]["source_uid"]
        if per_source > 0 and seen.get(uid, 0) >= per_source:
            tail.append(c)
        else:
            seen[uid] = seen.get(uid, 0) + 1
            head.append(c)
    final, dropped = head + tail, 0
    if limit > 0 and len(final) > limit:
        for i, c in enumerate(final[limit:], limit):
            if i >= len(head):
                held.append(("diversity", c))
            else:
                dropped += 1
        final = final[:limit]
    ledger = [(reason, c["count"], c["root"], None) for reason, c in held]
    ledger += [("duplicate_view", 1, g["root"], c["root"]) for c in final for view in c["views"] for g in view[1:]]
    return final, sorted(ledger, key=lambda x: (x[0], x[2])), dropped


def whole_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of rows ordered by query_id, cut again so that no query is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("query_id")
        begin = pc.index(ids, ids[-1]).as_py()
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = [batch.slice(begin)]
        elif held and held[-1].column("query_id")[-1] != ids[-1]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _values(column: pa.ChunkedArray) -> list:
    """As to_pylist; strings and what has no nulls by way of numpy, which is several times faster, values of lists at once."""

    def plain(a: pa.Array) -> list:
        return a.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(a.type) or not a.null_count else a.to_pylist()

    out = []
    for a in column.chunks:
        if pa.types.is_list(a.type):
            at = a.offsets.to_numpy().tolist()
            flat = plain(a.values.slice(at[0], at[-1] - at[0]))
            out += [flat[i - at[0] : j - at[0]] for i, j in pairwise(at)]
        else:
            out += plain(a)
    return out


def _rows(table: pa.Table) -> list[dict]:
    """Groups as ``clusters_of`` takes them."""
    plain = [c for c in table.column_names if not c.startswith("primary_")]
    primaries = zip(*(_values(table[f"primary_{c}"]) for c in _PRIMARY))
    rows = [dict(zip(plain, values)) for values in zip(*(_values(table[c]) for c in plain))]
    for row, values in zip(rows, primaries):
        row["primary"] = dict(zip(_PRIMARY, values))
    return rows


def fuse(candidates: DataFrame, sources: DataFrame, queries: DataFrame, floor: float = RELEVANCE_FLOOR, cap: float = CORROBORATION_CAP, limit: int = LIMIT, per_source: int = 0) -> tuple[DataFrame, DataFrame]:
    """(results, suppressions) of all queries. Candidates with a local rank below 1 or without locator fail the job."""
    checked = candidates.withColumn("local_rank", F.when((F.col("local_rank") < 1) | F.col("local_rank").isNull() | (F.coalesce("local", F.lit("")) == ""), F.raise_error(F.concat(F.lit("bad candidate "), F.coalesce("candidate_id", F.lit("?"))))).otherwise(F.col("local_rank")))
    groups = lineage_groups(checked, sources, queries)

    schema = T.StructType([*RESULT.fields, *ddl("kind string, reason string, count int, fused_into string").fields])
    arrow = to_arrow_schema(schema)

    def per_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_queries(batches):
            out = []
            for query_id, rows in groupby(_rows(table), key=lambda g: g["query_id"]):
                rows = list(rows)
                q = rows[0]
                kind = q["query_class"] or ""
                found = ordered(clusters_of(rows, cap), kind, q["stable"])
                final, ledger, _ = select_results(found, floor, q["limit"] or limit, per_source)
                for i, c in enumerate(final, 1):
                    p, b = c["primary"], c["basis"]
                    out.append((query_id, i, c["root"], p["source_uid"], p["source_id"], p["local"], p["candidate_id"], p["title"], p["excerpt"], p["excerpt_kind"], c["score"], promotable(c, kind, q["stable"]), c["independent"], c["cap_applied"], b["local_rank"], b["pool_size"], b["prior"], b["relevance"], c["members"], c["sources"], "result", None, None, None))
                out += [(query_id, None, root, *[None] * (len(RESULT) - 3), "suppression", reason, n, into) for reason, n, root, into in ledger]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for f, values in zip(arrow, zip(*out))], schema=arrow)

    whole = groups.repartition("query_id").sortWithinPartitions("query_id", "root")
    both = saved(whole.mapInArrow(per_query, schema))  # a few rows per query, read for both tables
    return both.where("kind = 'result'").select(*RESULT.names), both.where("kind = 'suppression'").select(*SUPPRESSION.names)


def group_scores(candidates: DataFrame, sources: DataFrame, by: str = "root", query_class: str = "") -> DataFrame:
    """(query_id, root, score) by built-ins alone, for candidates whose root is known."""
    best = best_by_source(candidates, ["query_id", by]).join(F.broadcast(sources.select("source_uid", "base_prior", "intent_priors")), "source_uid")
    p = prior(F.col("base_prior"), F.col("intent_priors"), F.lit(query_class))
    return best.groupBy("query_id", by).agg(F.max(rank_score(p, effective_relevance(F.col("relevance")), F.col("local_rank"))).alias("score"))


def corroborated(units: DataFrame, cap: float = CORROBORATION_CAP) -> DataFrame:
    """(query_id, cluster, score, cap_applied) where all units are independent: their sum, at most ``cap`` times the best."""
    total, most = F.sum("score"), F.max("score") * cap
    return units.groupBy("query_id", "cluster").agg(F.least(total, most).alias("score"), (total > most).alias("cap_applied"))


def components(links: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """(node, component): connected components of nodes that share keys, for pools of any size.

    Smallest labels spread over keys and are squared by following labels of labels, so the number of rounds is
    logarithmic in the longest chain. Rounds are checkpointed in the shared folder: lineage stays short.
    """
    labels = links.select(node).distinct().withColumn("component", F.col(node)).checkpoint()
    links = links.select(node, key).distinct()
    while True:
        by_key = links.join(labels, node).groupBy(key).agg(F.min("component").alias("low"))
        near = links.join(by_key, key).groupBy(node).agg(F.min("low").alias("low"))
        after = labels.join(near, node).select(node, F.least("component", "low").alias("component"), F.col("component").alias("before"))
        jump = after.select(F.col(node).alias("component"), F.col("component").alias("further"))
        after = after.join(jump, "component", "left").select(node, F.least("component", "further").alias("component"), "before")
        after = after.checkpoint()
        if after.where("component <> before").isEmpty():
            return after.select(node, "component")
        labels = after.select(node, "component")
