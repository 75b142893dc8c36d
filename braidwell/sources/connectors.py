"""Records of tools that keep their own stores, read as JSON, and the surface for sources of one's own."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from braidwell.schema import ddl

TASK = ddl(
    """id string, state string, priority string, title string, tags array<string>, contexts array<string>, deferred boolean,
    scheduled timestamp, deadline timestamp, closed timestamp, headline string, available boolean, project string, line int,
    links array<struct<url:string,system:string>>, notes array<string>"""
)
ISSUE = ddl(
    """id string, title string, description string, status string, type string, priority string, points int, labels array<string>,
    parent_id string, acceptance string, sessions array<string>, created_at timestamp, updated_at timestamp, closed_at timestamp,
    logs array<struct<at:timestamp,line:string>>, review_history array<struct<at:timestamp,verdict:string>>"""
)
MAIL = ddl("id string, date string, `from` string, subject string, labels array<string>, messageCount int")
SEMANTIC = ddl("docid string, score double, file string, line int, title string, snippet string")


def records(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def tasks(corpus: DataFrame, projects: DataFrame) -> DataFrame:
    """Tasks with a valid id and a title; a project's own list of ids says more than the task does."""
    listed = projects.select(F.col("title").alias("__project"), F.explode("task_ids").alias("id")).groupBy("id").agg(F.min("__project").alias("__project"))
    return corpus.where("id RLIKE '^[0-9a-f]{8}$' AND title <> ''").join(listed, "id", "left").withColumn("project", F.coalesce(F.when(F.col("__project") != "", F.col("__project")), "project")).drop("__project")


def issues(listed: DataFrame, probed: DataFrame, most: int = 5000) -> DataFrame:
    """The store's list, at most ``most`` by latest change, and whatever its searches found besides, each once."""
    cut = listed.orderBy(F.desc("updated_at"), "id").limit(most)
    return cut.unionByName(probed.join(cut.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def mail_page(threads: DataFrame, flt: str | None = None, limit: int = 100) -> DataFrame:
    """One page of threads in the store's order."""
    return (threads if flt is None else threads.where(flt)).limit(limit)


def semantic_hits(hits: DataFrame, collection: str) -> DataFrame:
    """Hits of one's own collection with their span header taken off the snippet."""
    from braidwell.operators.records import span_header

    head = span_header(F.col("snippet"))
    return hits.where(F.col("file").startswith(f"{collection}/")).select("*", head["line"].alias("span_line"), head["lines"].alias("span_lines"), head["body"].alias("body"))


def replay(spark: SparkSession, transcript: list[dict], schema: T.StructType) -> DataFrame:
    """A recorded answer as a source: deterministic and without the tool."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in transcript], schema)


class Source(Protocol):
    """What a source of one's own implements: candidates for a batch of queries, expansion and health."""

    def search(self, queries: DataFrame) -> DataFrame: ...

    def expand(self, locators: DataFrame) -> DataFrame: ...

    def health(self) -> DataFrame: ...


class RecordSource(DataSource):
    """A plug-in source: ``format("braidwell_records")`` calls a function, named ``module:function``, per partition.

    The function gets (partition, partitions) and yields tuples of the schema given.
    """

    @classmethod
    def name(cls) -> str:
        return "braidwell_records"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["function"], int(self.options.get("partitions", "1")))


class _Reader(DataSourceReader):
    def __init__(self, function: str, parts: int):
        self.function, self.parts = function, parts

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        import importlib

        module, _, name = self.function.partition(":")
        yield from getattr(importlib.import_module(module), name)(partition.value, self.parts)


def load_config(text: str) -> list[dict]:
    """Sources from a TOML text, with defaults; unknown keys, bad priors and duplicate names are errors, all at once."""
    import tomllib

    known = {"id", "uid", "adapter", "location", "enabled", "base_prior", "intent_priors", "sensitivity", "derives_from", "record_types", "timeout_ms", "freshness_mode", "as_of_support", "relevance_basis"}
    data = tomllib.loads(text)
    base, out, problems = data.get("defaults", {}), [], []
    for i, s in enumerate(data.get("sources", [])):
        s = {**base, **s}
        problems += [f"source {i}: unknown key {k}" for k in sorted(set(s) - known)]
        if "id" not in s:
            problems.append(f"source {i}: id is required")
            continue
        if not 0.5 <= s.get("base_prior", 1.0) <= 2.0:
            problems.append(f"source {s['id']}: base_prior isn't between 0.5 and 2")
        out.append({"source_id": s["id"], "source_uid": s.get("uid", s["id"]), "adapter": s.get("adapter"), "location": s.get("location"), "enabled": s.get("enabled", True), "base_prior": float(s.get("base_prior", 1.0)), "intent_priors": {k: float(v) for k, v in s.get("intent_priors", {}).items()}, "sensitivity": int(s.get("sensitivity", 1)), "derives_from": s.get("derives_from"), "record_types": s.get("record_types", []), "timeout_ms": int(s.get("timeout_ms", 2000)), "freshness_mode": s.get("freshness_mode", "indexed"), "as_of_support": s.get("as_of_support", "none"), "relevance_basis": s.get("relevance_basis", "lexical_span")})
    ids = [s["source_id"] for s in out]
    problems += [f"source {x}: named twice" for x in sorted({x for x in ids if ids.count(x) > 1})]
    if problems:
        raise ValueError("; ".join(problems))
    return out


def sources_frame(spark: SparkSession, config: list[dict]) -> DataFrame:
    from braidwell.schema import SOURCE

    return spark.createDataFrame([tuple(s.get(f.name) for f in SOURCE.fields) for s in config], SOURCE)
