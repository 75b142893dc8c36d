"""URL filter by the likelihood ratio of two character models, one of accepted and one of rejected URLs.

Each model is a variable-order Markov model of bytes: contexts of up to ``ORDER`` bytes, as far as they
occurred, smoothed by Witten-Bell interpolation with the next shorter context down to a uniform byte. A URL's
score is log P(accepted) - log P(rejected), divided by its length in bytes; it is accepted if the score reaches a
threshold calibrated on labelled URLs of hosts that the models weren't fitted on: the lowest score that leaves the
fewest errors, both classes weighing the same.

Labels are a boolean column of the table, if one is named. Otherwise they come from a list of words: URLs whose host has one
of ``REJECTED`` among its words are rejected, the others accepted. That list is a stand-in for the judgments that a
corpus would bring along; the models carry it over to hosts and paths that spell such words otherwise or in part.
All labelled rows are used. One host in five, by a hash, calibrates and the others are fitted on; where one class has
hosts of one kind only, its rows do both. Spark counts the grams of ORDER + 1 bytes, which hold those of all shorter contexts, and
finds the threshold over all calibrating scores. Up to ``GRAMS`` distinct grams the models travel to the workers as arrays. Beyond,
nothing of their size leaves the tables: shares are joined level by level, and every byte of a URL with the
log ratio of its gram; sums are exact there, in steps of 2**-40. Both ways give the same scores up to rounding. All URLs are scored.

Defined cases: case doesn't matter. A null or empty url has a null score and isn't accepted. Null labels aren't trained on.
Without labelled rows of both classes there is no ratio: scores are null and every URL is accepted. URLs of any length
are scored whole. Repeated rows get the same score; ties of the threshold are accepted. Other columns, whatever their
names, don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwell.llm.common import Scratch, read_table, slices, text_buffers

ORDER = 5
GRAMS = 1 << 20  # distinct grams whose counts the driver and each worker hold as arrays
_UNIT = 2.0**40
_BASE = 1 / 230  # share of any byte but capitals, before anything is counted
REJECTED = ("ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
_U = np.uint64


def grams(raw: np.ndarray, offsets: np.ndarray, order: int):
    """For k = 0..order: keys of each byte's context of k bytes and of the context with the byte itself.

    Keys hold the bytes themselves and k, so none collide. Before a text stand bytes of value 2.
    """
    low = raw.astype(np.uint64)
    low[(raw >= 65) & (raw <= 90)] += _U(32)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(len(raw), np.uint64)
    for k in range(order + 1):
        if k:
            before = np.full(len(raw), 2, np.uint64)
            inside = place >= k
            at = np.flatnonzero(inside)
            before[at] = low[at - k]
            context = context | before << _U(8 * k)
        tag = _U(k + 1) << _U(56)
        yield context | tag, context | low | tag


def longest(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The gram of order + 1 bytes that ends at each byte; its last bytes are the shorter grams."""
    *_, (_, full) = grams(raw, offsets, order)
    return full & _U((1 << 56) - 1)


class Markov:
    """Counts of contexts and grams by order, as sorted keys."""

    def __init__(self, texts: list[str], order: int = ORDER):
        raw, offsets, _ = text_buffers(pa.array(texts, pa.string()))
        self._fill(*np.unique(longest(raw, offsets, order), return_counts=True), order)

    @classmethod
    def counted(cls, gram: np.ndarray, n: np.ndarray, order: int = ORDER) -> Markov:
        """From the distinct longest grams and their counts."""
        out = cls.__new__(cls)
        out._fill(gram.astype(np.uint64), n, order)
        return out

    def _fill(self, gram: np.ndarray, n: np.ndarray, order: int) -> None:
        self.order, self.levels = order, []
        for k in range(order + 1):
            g, at = np.unique(gram & _U((1 << 8 * (k + 1)) - 1) | _U(k + 1) << _U(56), return_inverse=True)
            each = np.bincount(at, n, len(g)).astype(np.float64)
            c, at, seen = np.unique(g & ~_U(255), return_inverse=True, return_counts=True)
            self.levels.append((c, np.bincount(at, each, len(c)).astype(np.float64), seen.astype(np.float64), g, each))

    def log_probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text."""
        p = np.full(len(raw), _BASE)
        for (context, full), (c, total, kinds, g, n) in zip(grams(raw, offsets, self.order), self.levels):
            if not len(c):
                continue
            i = np.minimum(np.searchsorted(c, context), len(c) - 1)
            j = np.minimum(np.searchsorted(g, full), len(g) - 1)
            known = c[i] == context
            seen = np.where(g[j] == full, n[j], 0)
            p = np.where(known, (seen + kinds[i] * p) / (total[i] + kinds[i]), p)
        n = len(offsets) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(offsets)), np.log(p), n)


def ratio(accepted: Markov, rejected: Markov, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return (accepted.log_probability(raw, offsets) - rejected.log_probability(raw, offsets)) / np.maximum(np.diff(offsets), 1)


def calibrate(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the least sum of error shares; midway to the next lower score."""
    scores = np.concatenate([good, bad])
    order = np.argsort(scores, kind="stable")
    step = np.where(order < len(good), max(len(bad), 1), -max(len(good), 1))[: len(order)]  # shares times both sizes, so exact
    cost = np.concatenate([[0], np.cumsum(step)])  # accepted lost less rejected caught, below each cut
    s = scores[order]
    cut = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = int(np.flatnonzero(cut)[np.argmin(cost[cut])])
    if best == 0 or best == len(s):
        return float(s[0] if best == 0 else np.nextafter(s[-1], np.inf))
    return float((s[best - 1] + s[best]) / 2)


def threshold(scores: DataFrame) -> float:
    """As ``calibrate``, of a table of score and rejected with rows of both classes, however many."""
    tally = scores.groupBy("score").agg(F.count_if(~F.col("rejected")).alias("good"), F.count_if("rejected").alias("bad")).withColumn("bin", F.floor(F.col("score") * 1024))
    bins = tally.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("top")).orderBy("bin").toPandas()  # scores lie within some +-30
    good, bad = int(bins.good.sum()), int(bins.bad.sum())
    starts = [(int(b), int(g), int(r), t) for b, g, r, t in zip(bins.bin, bins.good.cumsum() - bins.good, bins.bad.cumsum() - bins.bad, [None, *bins.top[:-1].tolist()])]
    starts = F.broadcast(scores.sparkSession.createDataFrame(starts, "bin long, lost long, caught long, top double"))
    below = Window.partitionBy("bin").orderBy("score")
    sofar = lambda c: F.coalesce(F.sum(c).over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = tally.join(starts, "bin").select(
        "score",
        F.coalesce(F.lag("score").over(below), "top").alias("before"),
        ((F.col("lost") + sofar("good")) * F.lit(bad) - (F.col("caught") + sofar("bad")) * F.lit(good)).alias("cost"),
    )
    best = cuts.orderBy("cost", "score").first()
    return best.score if best.before is None else (best.before + best.score) / 2


def _labels(words, label: str | None):
    """Columns: host of url, and rejected (by column ``label``, or by the words of the host)."""
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return host, F.col(label).cast("boolean") if label else F.arrays_overlap(F.split(host, "[^a-z0-9]+"), F.array(*map(F.lit, words)))


def labelled(pages: DataFrame, words=REJECTED, label: str | None = None) -> DataFrame:
    """url, host and rejected (by column ``label``, or by the words of its host)."""
    host, rejected = _labels(words, label)
    return pages.where("url IS NOT NULL AND url <> ''").select("url", host.alias("host"), rejected.alias("rejected")).where("rejected IS NOT NULL")


def roles(known: DataFrame):
    """(whether a labelled row is fitted on, whether it calibrates) as columns of rejected and held; None without both classes."""
    there = {(r.rejected, r.held) for r in known.select("rejected", "held").distinct().collect()}
    if len({r for r, _ in there}) < 2:
        return None
    own = lambda held: F.when(F.col("rejected"), (F.col("held") == held) if (True, held) in there else F.lit(True)).otherwise((F.col("held") == held) if (False, held) in there else F.lit(True))
    return own(False), own(True)


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """Of url and rejected (null: the grams only): each longest gram with its counts in both classes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "url", 1 << 21):
                raw, offsets, _ = text_buffers(part.column(0))
                kind = part.column(1).cast(pa.int8()).fill_null(2).to_numpy(zero_copy_only=False).repeat(np.diff(offsets))
                gram, at = np.unique(longest(raw, offsets, order), return_inverse=True)
                n = [np.bincount(at, kind == k, len(gram)).astype(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), *map(pa.array, n)], names=["gram", "a", "r"])

    return rows.select("url", "rejected").mapInArrow(run, "gram long, a long, r long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def _held(host):
    return (F.pmod(F.xxhash64(host, F.lit(43)), F.lit(5)) == 0).alias("held")


def fit(pages: DataFrame, words=REJECTED, order: int = ORDER, label: str | None = None, most: int | None = None):
    """(accepted model, rejected model, threshold) from all labelled rows; None without both classes, () where there
    are more than ``most`` distinct grams."""
    known = labelled(pages, words, label).select("url", "rejected", _held(F.col("host")))
    own = roles(known)
    if own is None:
        return None
    counts = gram_counts(known.where(own[0]), order)
    counts = (counts if most is None else counts.limit(most + 1)).toPandas()
    if most is not None and len(counts) > most:
        return ()
    gram = counts.gram.to_numpy()
    models = [Markov.counted(gram[n > 0], n[n > 0], order) for n in (counts.a.to_numpy(), counts.r.to_numpy())]
    shared = pages.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "url", 1 << 21):
                yield pa.RecordBatch.from_arrays([pa.array(ratio(*shared.value, *text_buffers(part.column(0))[:2])), part.column(1)], names=["score", "rejected"])

    return *models, threshold(known.where(own[1]).select("url", "rejected").mapInArrow(run, "score double, rejected boolean"))


def log_ratios(scratch: Scratch, rows: DataFrame, order: int) -> DataFrame:
    """Each longest gram of url with log P(accepted) - log P(rejected) of its last byte in steps of 2**-40.
    ``rows`` are fitted on by rejected, those without it only name their grams."""
    levels = [scratch.table(gram_counts(rows, order), f"grams{order}")]
    short = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
    for k in range(order - 1, -1, -1):
        levels.insert(0, scratch.table(levels[0].groupBy(short(k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")), f"grams{k}"))
    shares = None
    for k, level in enumerate(levels):
        level = level.withColumn("context", F.shiftright("gram", 8))
        seen = level.groupBy("context").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ka"), F.count_if(F.col("r") > 0).alias("kr"))
        level = level.join(seen, "context")
        if shares is None:
            level = level.withColumns({"pa": F.lit(_BASE), "pr": F.lit(_BASE)})
        else:
            level = level.withColumn("short", short(k - 1)).join(shares.withColumnRenamed("gram", "short"), "short")
        share = lambda c: F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"k{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"k{c}"))).otherwise(F.col(f"p{c}")).alias(f"p{c}")
        shares = level.select("gram", share("a"), share("r"))
    return shares.select("gram", F.round((F.log("pa") - F.log("pr")) * F.lit(_UNIT)).cast("decimal(20,0)").alias("odds"))


def judge_by_joins(pages: DataFrame, words=REJECTED, order: int = ORDER, label: str | None = None) -> DataFrame:
    """As ``judge``, for tables with rows of both classes; neither driver nor worker holds a model."""
    scratch = Scratch(pages.sparkSession)
    host, rejected = _labels(words, label)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", rejected.alias("rejected"), _held(host), F.monotonically_increasing_id().alias("row"))
    rows = scratch.table(rows, "pages")
    some = rows.where("url <> ''")
    fitted, calibrates = roles(some.where("rejected IS NOT NULL"))
    odds = scratch.table(log_ratios(scratch, some.select("url", F.when(fitted, F.col("rejected")).alias("rejected")), order), "odds")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "url", 1 << 18):
                raw, offsets, _ = text_buffers(part.column(1))
                row = part.column(0).to_numpy().repeat(np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(longest(raw, offsets, order).astype(np.int64))], names=["row", "gram"])

    places = some.select("row", "url").mapInArrow(run, "row long, gram long")
    sums = places.join(odds, "gram").groupBy("row").agg(F.sum("odds").cast("double").alias("odds"))
    scored = rows.join(sums, "row", "left").withColumn("score", F.col("odds") / F.lit(_UNIT) / F.octet_length("url"))
    scored = scratch.table(scored.drop("odds", "row"), "scored")
    least = threshold(scored.where("score IS NOT NULL AND rejected IS NOT NULL").where(calibrates).select("score", "rejected"))
    return scored.select("page_id", "url", "score", F.coalesce(F.col("score") >= least, F.lit(False)).alias("accepted"))


def judge(pages: DataFrame, words=REJECTED, order: int = ORDER, label: str | None = None, most: int = GRAMS) -> DataFrame:
    """page_id, url, score and accepted of every row; by joins where there are more than ``most`` distinct grams."""
    fitted = fit(pages, words, order, label, most)
    if fitted == ():
        return judge_by_joins(pages, words, order, label)
    model = pages.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "url", 1 << 21):
                raw, offsets, _ = text_buffers(part.column(1))
                some = np.diff(offsets) > 0
                if model.value is None:
                    score, accepted, known = np.zeros(len(some)), some, np.zeros(len(some), bool)
                else:
                    score, known = ratio(*model.value[:2], raw, offsets), some
                    accepted = some & (score >= model.value[2])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64(), mask=~known), pa.array(accepted)], names=["page_id", "url", "score", "accepted"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, url string, score double, accepted boolean")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
