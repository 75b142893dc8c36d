"""Fitting answers into a token budget, and the small projections of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwell.functions import text as X


def structured_cost(columns: list[str]) -> Column:
    """Tokens of a result written as JSON."""
    return X.token_estimate(F.to_json(F.struct(*columns)))


def pointer_cost(columns: list[str]) -> Column:
    return structured_cost(columns) + 1


def explained_cost(text: Column) -> Column:
    return X.token_estimate(text) + 2


def tool_cost(columns: list[str]) -> Column:
    """A tool answer carries the JSON once as text and once as structure."""
    return structured_cost(columns) * 2


def shape(results: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds kept ('whole', 'compressed' or null) and tokens used up to the row.

    results: query_id, position, whole, compressed (token costs). budgets: query_id, budget, frame. The frame comes
    first; whole results while they fit; from the first that doesn't fit on, compressed ones; after the first
    compressed one that doesn't fit, nothing. A budget of 0 or less holds everything.
    """
    upto = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    r = results.join(budgets, "query_id")
    r = r.withColumn("__whole", F.col("frame") + F.sum("whole").over(upto))
    free = F.col("budget") <= 0
    r = r.withColumn("__missed", F.max((F.col("__whole") > F.col("budget")) & ~free).over(upto))
    spent = F.max(F.when(~F.col("__missed"), F.col("__whole"))).over(Window.partitionBy("query_id"))
    r = r.withColumn("__spent", F.coalesce(spent, F.col("frame")))
    r = r.withColumn("__small", F.col("__spent") + F.sum(F.when(F.col("__missed"), F.col("compressed")).otherwise(0)).over(upto))
    kept = F.when(~F.col("__missed"), F.lit("whole")).when(F.col("__small") <= F.col("budget"), F.lit("compressed"))
    tokens = F.when(~F.col("__missed"), F.col("__whole")).when(F.col("__small") <= F.col("budget"), F.col("__small"))
    return r.withColumn("kept", kept).withColumn("tokens", tokens).drop("__whole", "__missed", "__spent", "__small")


def shape_report(shaped: DataFrame) -> DataFrame:
    """(query_id, kept, dropped, truncated, tokens)."""
    lost = F.count_if(F.col("kept").isNull())
    return shaped.groupBy("query_id").agg(F.count("kept").alias("kept"), lost.alias("dropped"), (lost > 0).alias("truncated"), F.coalesce(F.max("tokens"), F.max("frame")).alias("tokens"))


def starved(frame: Column, first_compressed: Column, budget: Column) -> Column:
    """Whether a frame leaves no room for the first result; the frame is then cut to its summary."""
    return (frame > budget) | (frame + F.coalesce(first_compressed, F.lit(0)) > budget)


def trimmed(frames: DataFrame) -> DataFrame:
    """Frames (budget, full, summary, first) with the one that is carried and whether it was cut."""
    cut = (F.col("budget") > 0) & starved(F.col("full"), F.col("first"), F.col("budget")) & (F.col("summary") < F.col("full"))
    return frames.withColumn("cut", cut).withColumn("frame", F.when(cut, F.col("summary")).otherwise(F.col("full")))


def carried(suppressed: DataFrame, shown: DataFrame) -> DataFrame:
    """Suppressions of folded views only with the result they were folded into; the others always."""
    views = suppressed.where("reason = 'duplicate_view'")
    keep = views.join(shown.select("query_id", F.col("lineage_root").alias("fused_into")), ["query_id", "fused_into"], "left_semi")
    return suppressed.where("reason <> 'duplicate_view'").unionByName(keep.select(suppressed.columns))


def compressed(results: DataFrame) -> DataFrame:
    """Results without excerpt and members."""
    out = results.withColumn("excerpt", F.lit(None).cast("string")).withColumn("excerpt_kind", F.lit(None).cast("string"))
    return out.withColumn("members", F.lit(None).cast("array<string>")) if "members" in results.columns else out


def pointer(results: DataFrame) -> DataFrame:
    """What a caller needs to name a result; corroboration only where more than one unit stands behind it."""
    return results.select(
        "query_id", F.col("position").alias("rank"), F.concat_ws(":", "source_id", "local").alias("locator"), "source_id", "title", "excerpt", "excerpt_kind",
        F.col("exact_promoted").alias("exact"), F.when(F.col("independent_units") > 1, F.col("independent_units")).alias("corroboration"),
    )


def explanation(results: DataFrame) -> Column:
    """One line that says why a result stands where it does."""
    base = F.format_string("%s rank %d of %d, prior %.2f, score %.6f", "source_id", "local_rank", "pool_size", "prior", "score")
    relevance = F.when(F.col("relevance").isNotNull(), F.format_string("relevance %.4f", "relevance"))
    units = F.when(F.col("independent_units") > 1, F.format_string("%d independent units from %s", "independent_units", F.array_join("sources", ", ")))
    return F.concat_ws("; ", base, relevance, units, F.when(F.col("cap_applied"), F.lit("corroboration capped")), F.when(F.col("exact_promoted"), F.lit("exact match promoted")))
