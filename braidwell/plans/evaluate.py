"""Retrieval evaluation: metrics per case, means over groups, gates and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOISE = 1e-9
METRICS = ("ndcg_at_10", "required_at_5", "required_at_20", "mrr_at_10", "success_at_5", "forbidden_at_5", "abstention_accuracy", "coverage_accuracy", "locator_success", "provenance_accuracy", "source_outcome_accuracy")
USEFUL, AUTHORITATIVE = 2, 3


def canonical(ranked: DataFrame, judgments: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folded views read as what they were folded into: first position of each root, highest grade of each judgment.

    ranked: case_id, position, root; judgments: case_id, root, grade, required, forbidden; aliases: case_id, root, fused_into.
    """
    a = aliases.select(F.col("case_id").alias("__case"), F.col("root").alias("__root"), F.col("fused_into").alias("__into")).dropDuplicates(["__case", "__root"])
    at = (F.col("case_id") == F.col("__case")) & (F.col("root") == F.col("__root"))
    swap = lambda df: df.join(a, at, "left").withColumn("root", F.coalesce("__into", "root")).select(df.columns)
    firsts = swap(ranked).groupBy("case_id", "root").agg(F.min("position").alias("position"))
    renumbered = firsts.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("position")))
    graded = swap(judgments).groupBy("case_id", "root").agg(F.max("grade").alias("grade"), F.max("required").alias("required"), F.max("forbidden").alias("forbidden"))
    return renumbered, graded


def ndcg(ranked: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, ndcg): linear gain, log2 discount; null where no judgment is positive."""
    gain = F.col("grade") / F.log2(F.col("position") + 1)
    got = ranked.where(F.col("position") <= k).join(judgments.select("case_id", "root", "grade"), ["case_id", "root"]).groupBy("case_id").agg(F.sum(gain).alias("dcg"))
    best = judgments.where("grade > 0").withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "root"))).where(F.col("position") <= k)
    ideal = best.groupBy("case_id").agg(F.sum(gain).alias("ideal"))
    every = judgments.select("case_id").distinct()
    return every.join(ideal, "case_id", "left").join(got, "case_id", "left").select("case_id", F.round(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")), 6).alias("ndcg"))


def found_share(ranked: DataFrame, wanted: DataFrame, k: int, name: str) -> DataFrame:
    """(case_id, name): share of the wanted roots among the first k."""
    hit = wanted.join(ranked.where(F.col("position") <= k).select("case_id", "root", F.lit(1).alias("__hit")), ["case_id", "root"], "left")
    return hit.groupBy("case_id").agg(F.round(F.count("__hit") / F.count("*"), 6).alias(name))


def reciprocal_rank(ranked: DataFrame, wanted: DataFrame, k: int = 10, name: str = "mrr") -> DataFrame:
    """(case_id, name): 1 / first position of a wanted root within k, else 0."""
    hit = wanted.join(ranked.where(F.col("position") <= k), ["case_id", "root"], "left")
    return hit.groupBy("case_id").agg(F.round(F.coalesce(1 / F.min("position"), F.lit(0.0)), 6).alias(name))


def hit_at(ranked: DataFrame, wanted: DataFrame, k: int, name: str) -> DataFrame:
    hit = wanted.join(ranked.where(F.col("position") <= k), ["case_id", "root"], "left")
    return hit.groupBy("case_id").agg(F.max(F.col("position").isNotNull()).cast("double").alias(name))


def percentile(df: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """Nearest rank, not interpolated."""
    return df.groupBy(*(by or [])).agg(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(value))


def score_cases(cases: DataFrame, ranked: DataFrame, judgments: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row per case with the metrics that its judgments define; undefined ones are null, not zero.

    cases: case_id, tags, expected_behavior; outcomes: case_id, behavior, and further accuracies as columns.
    """
    of = lambda condition: judgments.where(condition).select("case_id", "root").distinct()
    parts = [
        ndcg(ranked, judgments).withColumnRenamed("ndcg", "ndcg_at_10"),
        found_share(ranked, of("required"), 5, "required_at_5"), found_share(ranked, of("required"), 20, "required_at_20"),
        reciprocal_rank(ranked, of(f"grade = {AUTHORITATIVE}"), 10, "mrr_at_10"),
        hit_at(ranked, of(f"grade >= {USEFUL}"), 5, "success_at_5"), hit_at(ranked, of("forbidden"), 5, "forbidden_at_5"),
    ]
    out = cases
    for part in parts:
        out = out.join(part, "case_id", "left")
    if outcomes is not None:
        out = out.join(outcomes, "case_id", "left")
        if "behavior" in outcomes.columns and "expected_behavior" in cases.columns:
            out = out.withColumn("abstention_accuracy", F.when(F.col("expected_behavior").isNotNull(), (F.col("behavior") == F.col("expected_behavior")).cast("double")))
    return out


def case_accuracies(expansions: DataFrame, expected_revisions: DataFrame, provenance: DataFrame, source_outcomes: DataFrame, expected_outcomes: DataFrame) -> DataFrame:
    """(case_id, locator_success, provenance_accuracy, source_outcome_accuracy).

    expansions: case_id, root (null: didn't resolve), revision; expected_revisions: case_id, root, want;
    provenance: case_id, correct; source_outcomes and expected_outcomes: case_id, source_uid, outcome or want.
    """
    e = expansions.join(expected_revisions, ["case_id", "root"], "left")
    ok = F.col("root").isNotNull() & (F.col("want").isNull() | (F.col("want") == F.col("revision")))
    locator = e.groupBy("case_id").agg(F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("locator_success"))
    proof = provenance.groupBy("case_id").agg(F.avg(F.col("correct").cast("double")).alias("provenance_accuracy"))
    o = expected_outcomes.join(source_outcomes, ["case_id", "source_uid"], "left").groupBy("case_id").agg(F.avg(F.coalesce(F.col("outcome") == F.col("want"), F.lit(False)).cast("double")).alias("source_outcome_accuracy"))
    return locator.join(proof, "case_id", "full").join(o, "case_id", "full")


def means(scores: DataFrame, metrics: list[str], by: Column | str | None = None) -> DataFrame:
    """Mean and population of each metric; nulls don't count."""
    aggs = [x for m in metrics for x in (F.round(F.avg(m), 6).alias(m), F.count(m).alias(f"{m}_n"))]
    return scores.agg(*aggs) if by is None else scores.groupBy(by).agg(*aggs)


def grouped_report(scores: DataFrame, metrics: list[str], groups: str = "tags") -> DataFrame:
    """Means overall and by group in one pass: level 'overall' or 'group'. A case counts in each of its groups."""
    apart = scores.select("case_id", F.explode_outer(groups).alias("group"), *metrics)
    # overall must count each case once, however many groups it is in
    first = F.row_number().over(Window.partitionBy("case_id").orderBy("group")) == 1
    apart = apart.withColumn("__first", first)
    stacked = apart.where("group IS NOT NULL").select(F.lit("group").alias("level"), "group", *metrics).unionByName(apart.where("__first").select(F.lit("overall").alias("level"), F.lit("overall").alias("group"), *metrics))
    aggs = [x for m in metrics for x in (F.round(F.avg(m), 6).alias(m), F.count(m).alias(f"{m}_n"))]
    return stacked.groupBy("level", "group").agg(*aggs)


def macro(report: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of the groups' means, each group weighing the same."""
    return report.where("level = 'group'").agg(*(F.round(F.avg(m), 6).alias(m) for m in metrics))


def ceiling_violations(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, violations): results above the ceiling that a case asserts."""
    return results.join(cases.where("ceiling IS NOT NULL").select("case_id", "ceiling"), "case_id").groupBy("case_id").agg(F.count_if(F.col("sensitivity") > F.col("ceiling")).alias("violations"))


def gates(scores: DataFrame, thresholds: dict[str, float], latency_budget_ms: float | None = None, integrity: int = 0) -> DataFrame:
    """(gate, status, observed, threshold), all from one aggregate over the cases.

    Columns used where present: sensitivity_violations, forbidden_at_5, locator_success, source_outcome_accuracy,
    coverage_accuracy, mrr_at_10, tags, abstention_accuracy, latency_ms, cold, assertion_violations, stale_expected.
    """
    have = set(scores.columns)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double") if c in have else F.lit(0.0)
    mean = lambda c: F.avg(c) if c in have else F.lit(None).cast("double")
    exact = F.avg(F.when(F.array_contains("tags", "exact") & F.col("mrr_at_10").isNotNull(), (F.col("mrr_at_10") == 1).cast("double"))) if {"tags", "mrr_at_10"} <= have else F.lit(None).cast("double")
    if {"latency_ms", "cold"} <= have:
        p95 = lambda cold: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE {'' if cold else 'NOT '}cold)").cast("double")
        latency = F.coalesce(p95(False), p95(True))
    else:
        latency = F.lit(None).cast("double")
    one = scores.agg(
        total("sensitivity_violations").alias("sensitivity"), (F.count_if(F.col("forbidden_at_5") > 0).cast("double") if "forbidden_at_5" in have else F.lit(0.0)).alias("forbidden"),
        mean("locator_success").alias("locators"), mean("source_outcome_accuracy").alias("source_outcomes"), mean("coverage_accuracy").alias("coverage"),
        exact.alias("exact_identifier"), mean("abstention_accuracy").alias("abstention"), latency.alias("latency"),
        total("assertion_violations").alias("assertions"), total("stale_expected").alias("expected_fails"), F.lit(float(integrity)).alias("integrity"),
    )
    kinds = {"sensitivity": ("count", 0.0), "forbidden": ("count", 0.0), "locators": ("rate", 1.0), "source_outcomes": ("rate", 1.0), "coverage": ("rate", 1.0), "exact_identifier": ("rate", thresholds.get("exact_identifier_success_at_1")), "abstention": ("rate", thresholds.get("abstention_accuracy")), "latency": ("most", latency_budget_ms), "assertions": ("count", 0.0), "expected_fails": ("count", 0.0), "integrity": ("count", 0.0)}
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(kind).alias("kind"), F.col(g).alias("observed"), F.lit(want).cast("double").alias("threshold")) for g, (kind, want) in kinds.items()))).alias("x")).select("x.*")
    bad = F.when(F.col("kind") == "rate", F.col("observed") < F.col("threshold")).otherwise(F.col("observed") > F.col("threshold"))
    status = F.when(F.col("observed").isNull() | F.col("threshold").isNull(), F.lit("skipped")).when(bad, F.lit("fail")).otherwise(F.lit("pass"))
    return rows.select("gate", status.alias("status"), F.round("observed", 6).alias("observed"), "threshold")


def long(report: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """One row per metric: keys, metric, value, n."""
    return report.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"{m}_n").cast("long").alias("n")) for m in metrics))).alias("x")).select(*keys, "x.*")


def compare(baseline: DataFrame, candidate: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, baseline, candidate, change, regression) of two reports.

    More forbidden evidence is worse, so its change counts the other way round. Differences up to 1e-9 are noise.
    A group that had a population and lost it is a regression.
    """
    b = long(baseline, metrics, keys).withColumnRenamed("value", "baseline").withColumnRenamed("n", "baseline_n")
    c = long(candidate, metrics, keys).withColumnRenamed("value", "candidate").withColumnRenamed("n", "candidate_n")
    sign = F.when(F.col("metric") == "forbidden_at_5", -1.0).otherwise(1.0)
    change = F.round((F.col("candidate") - F.col("baseline")) * sign, 6)
    both = b.join(c, [*keys, "metric"], "full").na.fill({"baseline_n": 0, "candidate_n": 0}).withColumn("change", change)
    lost = (F.col("baseline_n") > 0) & (F.col("candidate_n") == 0)
    return both.withColumn("regression", lost | F.coalesce(F.col("change") < -NOISE, F.lit(False)))


def case_changes(baseline: DataFrame, candidate: DataFrame, metrics: list[str]) -> DataFrame:
    """(case_id, metric, before, after) wherever a case's value moved, appeared or went."""
    flat = lambda df, name: df.select("case_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select("case_id", "x.*")
    both = flat(baseline, "before").join(flat(candidate, "after"), ["case_id", "metric"], "full")
    moved = F.abs(F.col("after") - F.col("before")) > NOISE
    return both.where(F.coalesce(moved, F.col("before").isNull() != F.col("after").isNull()))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A hash of a table that doesn't depend on the order of its rows or of its columns as given."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    return rows.select(row.alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("hash"))


def assertion_violations(a: dict[str, DataFrame], results: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(case_id, assertion, detail) of what cases assert about their answers and don't get.

    results: case_id, position, root, source_uid, excerpt, independent_units, record_id, fingerprint, bytes, revision, latency_ms.
    ``a`` holds a table per assertion: required_sources, forbidden_sources (case_id, source_uid), expected_revisions
    (root, want), suppressed_lineages, visible_lineages, expected_top_lineage (root), withheld_lineages (root, want),
    excerpt_contains (root, want), and min_results, max_results, max_corroborated_units, max_results_per_record,
    max_expansion_bytes, max_latency_ms (most or least).
    """
    out = []
    add = lambda df, name, detail: out.append(df.select("case_id", F.lit(name).alias("assertion"), detail.cast("string").alias("detail")))
    shown = results.select("case_id", "root").distinct()
    if "required_sources" in a:
        add(a["required_sources"].join(results.select("case_id", "source_uid").distinct(), ["case_id", "source_uid"], "left_anti"), "required_sources", F.col("source_uid"))
    if "forbidden_sources" in a:
        add(a["forbidden_sources"].join(results.select("case_id", "source_uid").distinct(), ["case_id", "source_uid"], "left_semi"), "forbidden_sources", F.col("source_uid"))
    if "expected_revisions" in a:
        j = a["expected_revisions"].join(results.select("case_id", "root", "revision"), ["case_id", "root"], "left")
        add(j.where("revision IS NULL OR revision <> want"), "expected_revisions", F.col("root"))
    if "visible_lineages" in a:
        add(a["visible_lineages"].join(shown, ["case_id", "root"], "left_anti"), "visible_lineages", F.col("root"))
    seen = suppressed.where("count > 0").select("case_id", F.col("lineage_root").alias("root"), "reason")
    if "suppressed_lineages" in a:
        s = a["suppressed_lineages"]
        add(s.join(shown, ["case_id", "root"], "left_semi").unionByName(s.join(shown, ["case_id", "root"], "left_anti").join(seen.where("reason = 'lineage_seen'").select("case_id", "root"), ["case_id", "root"], "left_anti")), "suppressed_lineages", F.col("root"))
    if "withheld_lineages" in a:
        w = a["withheld_lineages"].join(shown.withColumn("__shown", F.lit(True)), ["case_id", "root"], "left").join(seen, ["case_id", "root"], "left")
        add(w.where("__shown OR reason IS NULL OR reason <> want"), "withheld_lineages", F.col("root"))
    if "expected_top_lineage" in a:
        top = results.where("position = 1").select("case_id", F.col("root").alias("top"))
        add(a["expected_top_lineage"].join(top, "case_id", "left").where("top IS NULL OR top <> root"), "expected_top_lineage", F.col("root"))
    if "excerpt_contains" in a:
        e = a["excerpt_contains"].join(results.select("case_id", "root", "excerpt"), ["case_id", "root"], "left")
        add(e.where("excerpt IS NULL OR NOT contains(lower(excerpt), lower(want))"), "excerpt_contains", F.col("want"))
    per_case = results.groupBy("case_id").agg(F.count("*").alias("n"), F.max("independent_units").alias("units"), F.max("bytes").alias("bytes"), F.max("latency_ms").alias("latency"))
    for name, column, most in (("min_results", "n", False), ("max_results", "n", True), ("max_corroborated_units", "units", True), ("max_expansion_bytes", "bytes", True), ("max_latency_ms", "latency", True)):
        if name in a:
            j = a[name].join(per_case, "case_id", "left").withColumn("__got", F.coalesce(column, F.lit(0)))
            add(j.where(F.col("__got") > F.col("most") if most else F.col("__got") < F.col("least")), name, F.col("__got"))
    if "max_results_per_record" in a:
        slots = results.where("record_id <> '' AND fingerprint <> ''").groupBy("case_id", "record_id", "fingerprint").agg(F.count("*").alias("n"))
        add(a["max_results_per_record"].join(slots, "case_id").where("n > most"), "max_results_per_record", F.col("record_id"))
    from braidwell.plans.planning import pooled

    return pooled(out)
