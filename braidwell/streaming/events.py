"""An append-only event log as a source: versioned records, catch-up, snapshots, rewrites and refresh."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.streaming import appends

RECORD = """schema int, id string, kind string, event_time string, observed_at string, system string, ref string, correlation string,
    title string, body string, text string, actor string, revision string"""
MOST_BYTES = 1 << 20


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records with ``ok``: schema 1 says ``body``, schema 2 ``text`` and ``actor``; id and event time are required."""
    r = F.from_json(column, RECORD)
    p = lines.withColumn("__r", r)
    at = F.try_to_timestamp("__r.event_time")
    text = F.when(F.col("__r.schema") == 1, F.col("__r.body")).otherwise(F.col("__r.text"))
    fine = F.col("__r.schema").isin(1, 2) & (F.col("__r.id") != "") & at.isNotNull() & (F.octet_length(column) <= MOST_BYTES)
    return p.select(
        *[c for c in lines.columns if c != column], F.coalesce(fine, F.lit(False)).alias("ok"), F.col("__r.schema").alias("schema"), F.col("__r.id").alias("id"), F.col("__r.kind").alias("kind"),
        at.alias("event_time"), F.try_to_timestamp("__r.observed_at").alias("observed_at"), F.col("__r.system").alias("system"), F.col("__r.ref").alias("ref"),
        F.col("__r.correlation").alias("correlation"), F.col("__r.title").alias("title"), text.alias("text"), F.when(F.col("__r.schema") == 2, F.col("__r.actor")).alias("actor"), F.col("__r.revision").alias("revision"),
    )


def read(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, failed lines) of all files of a log, with their place in it. Lines that don't parse are counted and don't
    fail the rest."""
    p = parsed(appends.read_lines(spark, path).where("value <> ''"))
    return p.where("ok").drop("ok"), p.where("NOT ok").select("file", "position", "id")


def _cursor(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """Bytes of each file that the last run of a checkpoint took in."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = [int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()] if system.exists(folder) else []
    if not runs:
        return {}
    stored = spark.read.text(f"{checkpoint}/offsets/{max(runs)}", wholetext=True).first()[0]
    return json.loads(stored.strip().split("\n")[-1])


def catch_up(spark: SparkSession, path: str | list[str], table: str, checkpoint: str) -> dict:
    """Take in the lines that were appended since the last call, in one bounded run, and stop.

    The checkpoint is the durable cursor, a byte position per file: a line is taken in once, also if the run is repeated
    after a failure, and an unfinished last line waits. Late events are kept, whatever their time. A file that is shorter
    than its cursor, or gone, was rewritten: then table and cursor are dropped and the log is read from its beginning.
    Returns the run's number of lines, its generation and whether the log was rewritten.
    """
    now = appends.sizes(path)
    rewritten = any(now.get(file, 0) < taken for file, taken in _cursor(spark, checkpoint).items() if taken)
    if rewritten:
        for folder in (table, checkpoint):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    stream = parsed(appends.stream_lines(spark, path).where("value <> ''"))
    q = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = q.recentProgress
    return {"rows": sum(p.numInputRows for p in done), "generation": max((p.batchId for p in done), default=-1) + 1, "rewritten": rewritten}


def latest(records: DataFrame, by: tuple[str, ...] = ("schema", "id"), order: tuple[str, ...] = ("part", "file", "position")) -> DataFrame:
    """The last of each identity in log order; a log keeps all, a lookup wants the last. An identity is schema and id, so
    lines of both schemas with one id are two records; the later line counts, whatever its event time."""
    rest = [c for c in records.columns if c not in by]
    last = records.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*by, "__last.*").select(records.columns)


def snapshot(records: DataFrame) -> DataFrame:
    """One row that names a state of the log: a freshness label, not an event-time watermark."""
    return records.agg(F.count("*").alias("records"), F.max("event_time").alias("latest")).withColumn("label", F.concat(F.lit("records="), F.col("records"), F.lit(" latest="), F.coalesce(F.date_format("latest", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("none"))))


def stream_coverage(failed: Column, missing: Column, files: Column) -> Column:
    """unavailable if every file is missing, partial if lines failed or some are missing."""
    return F.when(missing >= files, F.lit("unavailable")).when((failed > 0) | (missing > 0), F.lit("partial")).otherwise(F.lit("complete"))


def rewritten(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files (path, size, head) that shrank, went, or begin otherwise than before: their index must be rebuilt."""
    n = now.select("path", F.col("size").alias("__size"), F.col("head").alias("__head"))
    return before.join(n, "path", "left").where("__size IS NULL OR __size < size OR __head <> head").select("path")


def progress(before: Column, after: Column) -> Column:
    """What a refresh did to a counter that should only grow."""
    return F.when(after > before, F.lit("advanced")).when(after == before, F.lit("unchanged")).otherwise(F.lit("regressed"))


def refresh_status(statuses: DataFrame) -> DataFrame:
    """One status for a refresh of many sources: ok, partial or failed. statuses: source_id, status."""
    bad, all_ = F.count_if(F.col("status") == "failed"), F.count("*")
    return statuses.agg(F.when(all_ == 0, F.lit("ok")).when(bad == all_, F.lit("failed")).when(bad > 0, F.lit("partial")).otherwise(F.lit("ok")).alias("status"))


def upstream(events: DataFrame, systems: dict[str, str]) -> DataFrame:
    """derived_from: the record in the system that an event came from, by the configured map of systems to sources."""
    table = F.create_map(*(F.lit(x) for kv in systems.items() for x in kv)) if systems else F.create_map().cast("map<string,string>")
    source = F.try_element_at(table, F.col("system"))
    known = source.isNotNull() & (F.coalesce("ref", F.lit("")) != "")
    return events.withColumn("derived_from", F.when(known, F.array(F.concat(source, F.lit(":"), F.col("ref")))).otherwise(F.array().cast("array<string>")))


def refresh(actions: dict) -> dict:
    """Run refreshes side by side on the driver; (status, detail) by source. Spark jobs of different threads share the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    def one(item):
        name, action = item
        try:
            return name, ("ok", action())
        except Exception as e:
            return name, ("failed", str(e))

    with ThreadPoolExecutor(max(1, min(8, len(actions)))) as pool:
        return dict(pool.map(one, actions.items()))
