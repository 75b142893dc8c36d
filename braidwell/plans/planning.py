"""Which sources a query may ask, and what their answers add up to: condition ladders and small aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwell.schema import QUIET_SKIPS

RESERVE_MS = 25
BUDGET_MS = 5000
TOKEN_BUDGET = 8000


def static_reason(scope: list[str] | None = None, ceiling: int = 3) -> Column:
    """Why a source isn't asked at all, null if it may be. Columns: enabled, source_id, sensitivity."""
    outside = F.lit(False) if not scope else ~F.col("source_id").isin(scope)
    return F.when(~F.col("enabled"), F.lit("disabled")).when(outside, F.lit("out_of_scope")).when(F.col("sensitivity") > ceiling, F.lit("sensitivity_ceiling"))


def dynamic_reason(record_types: Column, as_of: Column, left_ms: Column) -> Column:
    """Why a source that may be asked isn't, in order. Columns: handshake_ok, health, as_of_support, types."""
    mismatch = (F.size(record_types) > 0) & ~F.arrays_overlap("types", record_types)
    return (
        F.when(~F.col("handshake_ok"), F.lit("unreachable"))
        .when(F.col("health") == "denied", F.lit("denied"))
        .when(F.col("health") == "unavailable", F.lit("unavailable"))
        .when(as_of.isNotNull() & (F.col("as_of_support") == "none"), F.lit("as_of_unsupported"))
        .when(mismatch, F.lit("record_type_mismatch"))
        .when(left_ms <= RESERVE_MS, F.lit("budget_exhausted"))
    )


def store_conflicts(sources: DataFrame) -> DataFrame:
    """Adds conflict: sources that read the same physical store are all refused. Columns: adapter, identity."""
    n = F.count("*").over(Window.partitionBy("adapter", "identity"))
    return sources.withColumn("conflict", F.col("identity").isNotNull() & (n > 1))


def deadline(timeout_ms: Column, left_ms: Column) -> Column:
    return F.least(timeout_ms, left_ms - RESERVE_MS)


def within_deadline(outcome: Column, elapsed_ms: Column, allowed_ms: Column) -> Column:
    """Answers after their deadline count as timeouts."""
    return F.when(elapsed_ms > allowed_ms, F.lit("timeout")).otherwise(outcome)


def unsatisfiable(requested: DataFrame, sources: DataFrame, profile: DataFrame) -> DataFrame:
    """source_id and why: requested names that aren't configured, or aren't in the profile."""
    known = sources.select("source_id").distinct().withColumn("known", F.lit(True))
    inside = profile.select("source_id").distinct().withColumn("inside", F.lit(True))
    out = requested.select("source_id").distinct().join(known, "source_id", "left").join(inside, "source_id", "left")
    return out.select("source_id", F.when(F.col("known").isNull(), F.lit("source_not_configured")).when(F.col("inside").isNull(), F.lit("out_of_profile")).alias("reason")).where("reason IS NOT NULL")


def unsupported_filters(asked: set[str], honoured: set[str]) -> str | None:
    """Reason for skipping a source that can't honour a filter."""
    return "filter_unsupported: " + ", ".join(sorted(asked - honoured)) if asked - honoured else None


def degrades(outcome: Column, reason: Column) -> Column:
    """Whether a source's report makes coverage incomplete."""
    return F.when(outcome == "skipped", ~F.coalesce(reason.isin(*QUIET_SKIPS), F.lit(False))).otherwise(outcome != "success")


def coverage(reports: DataFrame) -> DataFrame:
    """(query_id, coverage) from reports (query_id, outcome, reason).

    Also degraded if nothing was searched and a skip says that it doesn't apply.
    """
    worse = F.bool_or(degrades(F.col("outcome"), F.col("reason")))
    silent = (F.count_if(F.col("outcome") != "skipped") == 0) & F.bool_or(F.coalesce(F.col("reason") == "not_applicable", F.lit(False)))
    return reports.groupBy("query_id").agg(F.when(worse | silent, F.lit("degraded")).otherwise(F.lit("complete")).alias("coverage"))


def outcome(reports: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, outcome): answered with results, failed if all that were asked failed, else abstained."""
    asked, searched = F.count_if(F.col("outcome") != "skipped"), F.count_if(F.col("outcome").isin("success", "partial"))
    per = reports.groupBy("query_id").agg(asked.alias("asked"), searched.alias("searched"))
    have = results.select("query_id").distinct().withColumn("have", F.lit(True))
    ladder = F.when(F.col("have"), F.lit("answered")).when((F.col("asked") > 0) & (F.col("searched") == 0), F.lit("failed")).otherwise(F.lit("abstained"))
    return per.join(have, "query_id", "left").select("query_id", ladder.alias("outcome"))


def source_summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy("query_id", "outcome").agg(F.count("*").alias("n"))


def degraded_list(reports: DataFrame) -> DataFrame:
    """(query_id, source_id, text) of the reports that degrade coverage."""
    text = F.concat(F.col("source_id"), F.lit(": "), F.col("outcome"), F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" ("), F.col("reason"), F.lit(")"))).otherwise(""))
    return reports.where(degrades(F.col("outcome"), F.col("reason"))).select("query_id", "source_id", text.alias("text"))


def reports(searches: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row per query and source, asked or not: outcome, reason, candidates, elapsed_ms.

    searches: query_id, source_id, outcome, stated (a reason of the source's own), error (a code), candidates, elapsed_ms.
    A source that skips without a reason of the known ones gets one that degrades. excluded: query_id, source_id, reason.
    """
    known = ("not_applicable", "unapplied_filter", "record_type_mismatch", "as_of_unsupported")
    skip = F.when(F.col("outcome") == "skipped", F.when(F.col("stated").isin(*known), F.col("stated")).otherwise(F.lit("unstated_skip")))
    asked = searches.select("query_id", "source_id", "outcome", F.coalesce(skip, F.when(F.col("error").isNotNull(), classify_error(F.col("error"))[1])).alias("reason"), "candidates", "elapsed_ms")
    return asked.unionByName(excluded.select("query_id", "source_id", F.lit("skipped").alias("outcome"), "reason", F.lit(0).cast("long").alias("candidates"), F.lit(None).cast("long").alias("elapsed_ms")))


def annotated(results: DataFrame, sources: DataFrame, states: DataFrame) -> DataFrame:
    """Results with the freshness of their source: how it is kept fresh, which state and index answered, how it honours as_of.
    sources: source_uid, freshness_mode, as_of_support; states: source_uid, revision, generation."""
    s = sources.select("source_uid", F.col("freshness_mode").alias("__mode"), F.col("as_of_support").alias("__as_of")).join(states.select("source_uid", "revision", "generation"), "source_uid", "left")
    fresh = F.struct(F.col("__mode").alias("mode"), "revision", "generation", F.col("__as_of").alias("as_of_honored"))
    return results.join(F.broadcast(s), "source_uid", "left").withColumn("freshness", fresh).select(*results.columns, "freshness")  # configured sources


def classify_error(code: Column) -> tuple[Column, Column]:
    """(outcome, reason) of an error code."""
    outcome_ = F.when(code == "deadline", F.lit("timeout")).when(code == "denied", F.lit("denied")).when(code.isin("unavailable", "unreachable"), F.lit("unavailable")).when(code.isin("as_of_unsupported", "filter_unsupported"), F.lit("skipped")).otherwise(F.lit("failed"))
    reason = F.when(code == "deadline", F.lit("timeout")).when(code.isin("denied", "cancelled", "as_of_unsupported", "filter_unsupported", "budget_exceeded"), code).when(code.isin("unavailable", "unreachable"), F.lit("unreachable")).otherwise(F.lit("failed"))
    return outcome_, reason


def index_coverage(documents: Column, vectors: Column) -> Column:
    return F.when(documents.isNull() | vectors.isNull(), F.lit("unknown")).when(vectors == 0, F.lit("none")).when(vectors < documents, F.lit("partial")).otherwise(F.lit("complete"))


def health(indexed: Column, current: Column, failures: Column) -> tuple[Column, Column]:
    """(status, coverage) from the watermark of the index, that of the corpus, and failed files."""
    stale = ~indexed.eqNullSafe(current)
    status = F.when(indexed.isNull(), F.lit("unavailable")).when(stale | (failures > 0), F.lit("degraded")).otherwise(F.lit("healthy"))
    cover = F.when(indexed.isNull(), F.lit("unknown")).when(stale | (failures > 0), F.lit("partial")).otherwise(F.lit("complete"))
    return status, cover


def permitted(candidates: DataFrame, ceiling: int) -> tuple[DataFrame, DataFrame]:
    """Candidates at or below the ceiling, and (query_id, denied) counts of the others."""
    ok = F.col("sensitivity") <= ceiling
    return candidates.where(ok), candidates.where(~ok).groupBy("query_id").agg(F.count("*").alias("denied"))


def raised(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Sensitivity raised to the floor of the source: a source can't lower it."""
    floors = sources.select("source_uid", F.col("sensitivity").alias("__floor"))
    return candidates.join(F.broadcast(floors), "source_uid", "left").withColumn("sensitivity", F.greatest("sensitivity", F.coalesce("__floor", F.lit(0)))).drop("__floor")  # configured sources


def stamped(candidates: DataFrame, uid: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Candidates under the core's name for their source, and the count of malformed ones, which are dropped."""
    sound = (F.col("local_rank") >= 1) & (F.coalesce("local", F.lit("")) != "")
    good = candidates.where(sound).withColumn("source_uid", F.lit(uid)).withColumn("source_id", F.lit(source_id))
    return good, candidates.agg(F.count_if(~F.coalesce(sound, F.lit(False))).alias("malformed"))


def pooled(parts: list[DataFrame]) -> DataFrame:
    """The sources' candidates as one pool."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def exit_code(outcome_: Column, coverage_: Column, surface: str = "cli") -> Column:
    """Severity of an answer: failed, then degraded, then abstained (only on the command line), then fine."""
    ladder = F.when(outcome_ == "failed", F.lit(2)).when(coverage_ == "degraded", F.lit(3))
    return (ladder.when(outcome_ == "abstained", F.lit(4)) if surface == "cli" else ladder).otherwise(F.lit(0))


@dataclass
class Request:
    query: str
    limit: int = 0
    mode: str = "explicit"
    detail: str = "excerpt"
    response_tokens: int = TOKEN_BUDGET
    timeout_ms: int = BUDGET_MS

    def __post_init__(self):
        problems = []
        if not self.query.strip():
            problems.append("query is required")
        if self.limit < 0:
            problems.append("limit must not be negative")
        if self.mode not in ("explicit", "pre_reply"):
            problems.append(f"unknown mode {self.mode}")
        if self.detail not in ("summary", "excerpt", "full", "context"):
            problems.append(f"unknown detail {self.detail}")
        if problems:
            raise ValueError("; ".join(problems))


def ranking_config(sources: list[dict], limit: int = 0, floor: float | None = None) -> dict:
    """Parameters of fusion from configuration: priors and intent priors per source, limit and floor."""
    from braidwell.schema import CORROBORATION_CAP, LIMIT, RANK_CONSTANT, RELEVANCE_FLOOR

    for s in sources:
        for value in (s.get("base_prior", 1.0), *(s.get("intent_priors") or {}).values()):
            if not 0.5 <= value <= 2.0:
                raise ValueError(f"prior {value} of {s['source_id']} isn't between 0.5 and 2")
    return {"priors": {s["source_uid"]: s.get("base_prior", 1.0) for s in sources}, "intent_priors": {s["source_uid"]: s.get("intent_priors") or {} for s in sources}, "limit": limit or LIMIT, "floor": RELEVANCE_FLOOR if floor is None else floor, "rank_constant": RANK_CONSTANT, "cap": CORROBORATION_CAP, "per_source": 0}
