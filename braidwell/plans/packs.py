"""Evaluation packs: cases and judgments from files, checked as a whole, run as one batch, and kept as artifacts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.functions.analyze import classify, stable_identifiers
from braidwell.operators.expand import rendered
from braidwell.plans import evaluate as V
from braidwell.schema import QUERY, conform
from braidwell.shared import saved

CASE_KEYS = {"schema_version", "case_id", "query", "profile", "as_of", "expected_behavior", "tags", "timeout_ms", "mode", "suppress_lineages", "scope", "assertions", "expected_fail"}
JUDGMENT_KEYS = {"schema_version", "case_id", "lineage_root", "relevance", "required", "forbidden", "supports"}
BEHAVIORS = ("answer", "abstain", "fail")


@dataclass
class Pack:
    manifest: dict
    cases: list[dict]
    judgments: list[dict] = field(default_factory=list)

    @property
    def thresholds(self) -> dict[str, float]:
        return self.manifest.get("thresholds") or {}


def problems(pack: Pack) -> list[str]:
    """Everything that is wrong with a pack, at once."""
    out, seen = [], set()
    if pack.manifest.get("schema_version") != 1:
        out.append("pack: schema_version must be 1")
    for i, c in enumerate(pack.cases):
        name = c.get("case_id") or f"case {i}"
        out += [f"{name}: unknown key {k}" for k in sorted(set(c) - CASE_KEYS)]
        out += [f"{name}: {k} is required" for k in ("case_id", "query") if not c.get(k)]
        if c.get("expected_behavior") not in (None, *BEHAVIORS):
            out.append(f"{name}: unknown expected_behavior {c['expected_behavior']}")
        if c.get("case_id") in seen:
            out.append(f"{name}: named twice")
        seen.add(c.get("case_id"))
    judged = set()
    for i, j in enumerate(pack.judgments):
        name = f"judgment {i}"
        out += [f"{name}: unknown key {k}" for k in sorted(set(j) - JUDGMENT_KEYS)]
        if j.get("case_id") not in seen:
            out.append(f"{name}: no case {j.get('case_id')}")
        if ":" not in (j.get("lineage_root") or ""):
            out.append(f"{name}: lineage_root must be uid:local")
        if j.get("relevance") not in (0, 1, 2, 3):
            out.append(f"{name}: relevance must be 0 to 3")
        if j.get("required") and j.get("forbidden"):
            out.append(f"{name}: both required and forbidden")
        if (j.get("case_id"), j.get("lineage_root")) in judged:
            out.append(f"{name}: judged twice")
        judged.add((j.get("case_id"), j.get("lineage_root")))
    return out


def load(folder: str) -> Pack:
    """A pack from pack.json, cases.jsonl and judgments.jsonl; its problems are one error."""
    lines = lambda name: [json.loads(x) for x in open(os.path.join(folder, name), encoding="utf-8") if x.strip()]
    with open(os.path.join(folder, "pack.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    pack = Pack(manifest, lines(manifest.get("cases", "cases.jsonl")), lines(manifest.get("judgments", "judgments.jsonl")))
    found = problems(pack)
    if found:
        raise ValueError("; ".join(found))
    return pack


def queries(spark: SparkSession, pack: Pack) -> DataFrame:
    """The cases as a batch of queries, numbered in the order of the pack."""
    rows = [(i, c["query"], classify(c["query"]), stable_identifiers(c["query"]), c.get("mode", "explicit"), c.get("suppress_lineages") or []) for i, c in enumerate(pack.cases)]
    return conform(spark.createDataFrame(rows, "query_id long, query string, query_class string, stable_identifiers array<string>, mode string, suppress_lineages array<string>"), QUERY)


def run(spark: SparkSession, pack: Pack, search: Callable[[DataFrame], tuple[DataFrame, DataFrame]], chunks: DataFrame | None = None, detail: str = "excerpt") -> tuple[DataFrame, DataFrame]:
    """(scores per case, gates). ``search`` takes the batch of queries and returns results and suppressions, as ``fuse`` does.

    With ``chunks`` (source_uid, local, title, text, locator) every result is expanded: locator_success is the share of a
    case's results that gave some content.
    """
    results, ledger = search(queries(spark, pack))
    cases = spark.createDataFrame([(i, c["case_id"], c.get("tags") or [], c.get("expected_behavior")) for i, c in enumerate(pack.cases)], "query_id long, case_id string, tags array<string>, expected_behavior string")
    judged = spark.createDataFrame([(j["case_id"], j["lineage_root"], int(j["relevance"]), bool(j.get("required")), bool(j.get("forbidden"))) for j in pack.judgments], "case_id string, root string, grade int, required boolean, forbidden boolean")
    ranked = results.join(cases, "query_id").select("case_id", "position", F.col("lineage_root").alias("root"))
    aliases = ledger.where("reason = 'duplicate_view'").join(cases, "query_id").select("case_id", F.col("lineage_root").alias("root"), "fused_into")
    answered = ranked.select("case_id").distinct().withColumn("__some", F.lit(True))
    outcomes = cases.join(answered, "case_id", "left").select("case_id", F.when(F.col("__some"), "answer").otherwise("abstain").alias("behavior"))
    if chunks is not None:
        held = results.select("query_id", "source_uid", "local").join(chunks, ["source_uid", "local"], "left").join(cases.select("query_id", "case_id"), "query_id")
        got = rendered(held, F.lit(detail)).groupBy("case_id").agg(F.avg(F.coalesce(F.col("content") != "", F.lit(False)).cast("double")).alias("locator_success"))
        outcomes = outcomes.join(got, "case_id", "left")
    scores = saved(V.score_cases(cases.drop("query_id"), *map(saved, V.canonical(ranked, judged, aliases)), outcomes))
    return scores, V.gates(scores, pack.thresholds, (pack.manifest.get("budgets") or {}).get("p95_latency_ms"))


def write(scores: DataFrame, gates: DataFrame, header: dict, folder: str) -> None:
    """A run's artifacts: a line per case, the gates and a header."""
    scores.write.mode("overwrite").json(f"{folder}/cases")
    gates.write.mode("overwrite").json(f"{folder}/gates")
    scores.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run")
