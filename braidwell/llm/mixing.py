"""Mixing sources to target weights by fitting token budgets exactly.

Documents are counted by source and exact token length. Each source's budget is its weight times the total
budget; a source that holds less gives all it has and the shortfall goes to the others in proportion. From a
source, the same share of every length is taken (rounded down); what the rounding leaves of the budget is
filled with one more document of each of the longest lengths while more than ``SPAN`` tokens are left, and
the rest by bounded-knapsack dynamic programming over the lengths and counts still available (a bitset of
reachable sums). Of each length the required number of documents is taken in the order of a seeded hash.

By default weights are the sources' token shares raised to ``ALPHA``, and the total budget is ``FRACTION`` of
all tokens. Per source, only (length, count) pairs reach the task that fits it: bounded by the number of
distinct lengths, however large the corpus. Only one row per source reaches the driver.

Defined cases: null and empty texts have no tokens and aren't selected; nor are rows with a null doc_id or a
null source (it has no weight) or a source without weight. Rows that share a doc_id are one document with
all their tokens, of the smallest of their sources. Ties of the hash go by doc_id. Texts of any length are counted
whole. Other columns, whatever their names, are carried by ``mixed`` and don't matter to ``select``. An empty table or a zero
budget selects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwell.llm.common import Scratch, keep_ids, read_table
from braidwell.llm.packing import fullest
from braidwell.llm.tokens import VOCABULARY, with_lengths

ALPHA = 0.7
FRACTION = 0.9
SPAN = 4096
SEED = 20240501


def budgets(tokens: Mapping[str, int], total: int, weights: Mapping[str, float] | None = None, alpha: float = ALPHA) -> dict[str, int]:
    """Tokens for each source: weight times total, at most what there is; shortfalls are shared out again."""
    if weights is None:
        weights = {s: n**alpha for s, n in tokens.items()}
    weight = {s: Fraction(weights.get(s, 0)) for s in tokens}
    open_, out, left = {s for s in tokens if tokens[s] > 0 and weight[s] > 0}, {}, total
    while open_:
        whole = sum(weight[s] for s in open_)
        short = {s for s in open_ if tokens[s] <= weight[s] * left / whole}
        if not short:
            return out | {s: int(weight[s] * left / whole) for s in open_}
        out |= {s: tokens[s] for s in short}
        left -= sum(tokens[s] for s in short)
        open_ -= short
    return out


def fit(counts: dict[int, int], budget: int, span: int = SPAN) -> dict[int, int]:
    """How many documents of each length to take: as many tokens as fit into ``budget``, all lengths alike."""
    total = sum(n * c for n, c in counts.items())
    if total <= budget:
        return dict(counts)
    take = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * k for n, k in take.items())
    order = sorted(counts, reverse=True)
    for n in order:
        if take[n] < counts[n] and n <= left - span:
            take[n] += 1
            left -= n
    spare = {n: counts[n] - take[n] for n in order if counts[n] > take[n]}
    for n, k in fullest([n for n in order if n in spare], spare, left).items():
        take[n] += k
    return take


def select(spark: SparkSession, docs: DataFrame, weights: Mapping[str, float] | None = None, fraction: float = FRACTION, alpha: float = ALPHA, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents taken."""
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    sized = with_lengths(rows, ["doc_id", "source"], vocabulary).groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    sized = scratch.table(sized, "sized")
    counts = scratch.table(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "counts")
    tokens = {r.source: r.t for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()}
    goal = budgets(tokens, int(Fraction(str(fraction)) * sum(tokens.values())), weights, alpha)

    def plan(key, pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit(dict(zip(pdf["n_tokens"].tolist(), pdf["n"].tolist())), goal.get(key[0], 0))
        return pd.DataFrame({"source": key[0], "n_tokens": list(take), "take": list(take.values())})

    taken = scratch.table(counts.groupBy("source").applyInPandas(plan, "source string, n_tokens long, take long").where("take > 0"), "taken")
    seeded = Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    # the window needs the join's partitioning anyway, so nothing is broadcast and nothing is shuffled twice
    chosen = sized.join(taken.hint("shuffle_hash"), ["source", "n_tokens"]).withColumn("rank", F.row_number().over(seeded)).where("rank <= take")
    return chosen.select("doc_id", "source", "n_tokens")


def mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``select`` takes."""
    return keep_ids(docs, select(spark, docs, **how))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, read_table(spark, sf_dir, "documents"))
