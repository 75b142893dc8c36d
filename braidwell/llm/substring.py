"""Removal of passages that other documents already have, by hashing lines and passages.

Two kinds of units are hashed to 96 bits over their words, without case, punctuation and spacing:

* lines of at least ``line_words`` words (about a sentence; shorter ones, such as headings, greetings and licence
  notices, recur by form and stay);
* passages of at least ``min_words`` words, for what is pasted into the middle of lines or runs over several. Where they
  begin and end is decided by the words themselves. One begins at every line's first word and, of any ``GAP`` words of a
  line, at the one whose hash (with the word after it in the line) is smallest, first words of sentences before others; it ends at
  the first border that leaves it ``min_words`` words: a line's or a sentence's end or, in sentences, the smallest hash of
  any ``GAP`` / 2 words. Every line end ends one more, which begins at the last such place. A repeat of ``min_words`` + 2
  ``GAP`` words therefore holds a whole passage wherever it begins (one that begins with a line, of ``min_words`` + ``GAP``),
  and nothing shorter than ``min_words`` in a row is taken, however many sentences it shares. At the ends of a repeat
  fewer than 1.5 ``GAP`` words may stay.

Digests are grouped over the whole table and the earliest document, by doc_id, keeps each unit; the units of later
documents go, and inside one document all but the first occurrence (one that overlaps it isn't another). A removed span is
the union of adjoining units that the same document keeps; it ends where the keeping document changes, and carries
the original character offsets [start, stop). Stops of other scripts end sentences as well, and so does a space between
words of a script written without spaces, such as Thai; two letters of Han or Kana, or three of Thai and the like, count
as a word and ``GAP`` is doubled there.

Defined cases: null and empty texts stay as they are. Rows with a null doc_id stay as they are and take no
part. Rows that share a doc_id are one document: what they share with one another stays. A document of
which nothing remains goes from ``cleaned`` and has an empty text in ``repeats``. Texts of any length are hashed whole.
Equal digests are settled by doc_id alone, so there are no ties. Other columns are carried by ``cleaned``, whatever
their names, and don't matter to ``repeats``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwell.llm.common import HAN, THAI, Scratch, Words, _powers, char_positions, fresh, mix, read_table, slices, text_buffers

MIN_WORDS = 30
LINE_WORDS = 15
GAP = 16
_U = np.uint64
_UNITS = "doc_id long, version int, start int, stop int, again boolean, h1 long, h2 int"
_WEIGHT = np.zeros(8, np.int64)
_WEIGHT[[1, HAN, THAI]] = 6, 3, 2  # sixths of a word


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over a[i : i + width] of each i that has so many after it."""
    size = 1
    while 2 * size <= width:
        a, size = op(a[:-size], a[size:]), 2 * size
    return a if size == width else op(a[: len(a) - (width - size)], a[width - size :])


def cuts(key: np.ndarray, forced: np.ndarray, preferred: np.ndarray, spaced: np.ndarray, gap: int) -> np.ndarray:
    """Some of the words: all ``forced`` ones and, of any ``gap`` words without one, the one of the smallest key, ``preferred``
    ones before others; of twice as many in scripts without spaces."""
    key = key >> _U(1) | _U(1)
    key[~preferred] |= _U(1 << 63)
    key[forced] = 0
    out = forced.copy()
    for wide, own in ((gap, spaced), (2 * gap, ~spaced)):
        if own.any():
            pad = np.zeros(wide - 1, np.uint64)  # outside the batch all is forced
            least = _sliding(np.minimum, np.concatenate([pad, key, pad]), wide)  # of the windows that end at each word and after
            out |= (key == _sliding(np.maximum, least, wide)) & own
    return out


def units(raw: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> dict[str, np.ndarray]:
    """Lines and passages of a batch of texts: doc, char offsets, repetition in the doc, digests."""
    w = Words(raw, offsets, by_class=True)
    n = len(w)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "stop", "again", "h1", "h2")}
    ends = np.flatnonzero(raw == 10)
    stop_at = (raw == 46) | (raw == 33) | (raw == 63)
    stop_at[w.stops] = True
    stops = np.concatenate([[0], np.cumsum(stop_at, dtype=np.int32)])
    lo, hi = w.ends[:-1], w.starts[1:]
    line, border = np.ones(n, bool), np.ones(n, bool)
    line[1:] = (w.doc[1:] != w.doc[:-1]) | (np.searchsorted(ends, hi) > np.searchsorted(ends, lo))
    phrase = (w.kind[1:] == THAI) & (w.kind[:-1] == THAI) & (hi > lo)
    border[1:] = line[1:] | ((stops[hi] > stops[lo]) & (hi - lo > 1)) | phrase
    h = w.hashes()
    after = np.append(h[1:], _U(0))
    after[:-1][line[1:]] = 0  # what follows a line, perhaps another text, doesn't count
    key = mix(h * _U(0xD6E8FEB86659FD93) + after, 3)
    at = np.flatnonzero(cuts(key, line, border, w.kind == 1, GAP))
    weight = np.concatenate([[0], np.cumsum(_WEIGHT[w.kind])])
    ways = np.append(np.flatnonzero(cuts(key, border, border, w.kind == 1, GAP // 2)), n)  # a text ends where the next begins
    until = np.searchsorted(weight[ways], weight[at] + 6 * min_words)
    enough = (until < len(ways)) & (ways[np.minimum(until, len(ways) - 1)] <= w.first[w.doc[at] + 1])
    first = np.flatnonzero(line)
    last = np.append(first[1:], n)
    long = weight[last] - weight[first] >= 6 * line_words
    tail = np.searchsorted(weight[at], weight[last] - 6 * min_words, side="right") - 1
    closed = (tail >= 0) & (at[tail] >= w.first[w.doc[first]]) & (ways[np.minimum(until[tail], len(ways) - 1)] != last)
    passages = int(enough.sum() + closed.sum())
    a = np.concatenate([at[enough], at[tail[closed]], first[long]])
    b = np.concatenate([ways[until[enough]], last[closed], last[long]])
    up, down = _powers(n)
    sums = lambda x: np.concatenate([[_U(0)], np.cumsum(x * up[:n])])
    one, two = sums(h), sums(mix(h, 5))
    salt = np.repeat(np.array([0, 0x5851F42D4C957F2D], np.uint64), [passages, len(a) - passages])
    h1 = mix((one[b] - one[a]) * down[a] + salt, 1)
    h2 = mix((two[b] - two[a]) * down[a] + (b - a).astype(np.uint64) + salt, 2) >> _U(32)
    doc = w.doc[a]
    chars = char_positions(raw)
    begin_byte, stop_byte = w.starts[a], np.where(b < w.first[doc + 1], w.starts[np.minimum(b, n - 1)], offsets[doc + 1])
    if len(ends):  # a line goes from its first character to its line end
        p = slice(passages, None)
        i = np.searchsorted(ends, w.starts[a[p]]) - 1
        begin_byte[p] = np.maximum(np.where(i >= 0, ends[i] + 1, 0), offsets[doc[p]])
        i = np.searchsorted(ends, w.ends[b[p] - 1])
        stop_byte[p] = np.minimum(np.where(i < len(ends), ends[np.minimum(i, len(ends) - 1)] + 1, len(raw)), offsets[doc[p] + 1])
    else:
        begin_byte[passages:] = offsets[doc[passages:]]
        stop_byte[passages:] = offsets[doc[passages:] + 1]
    base = chars[offsets[:-1]][doc]
    start, stop = chars[begin_byte] - base, chars[stop_byte] - base
    order = np.lexsort((start, h2, h1, doc))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (doc, h1, h2)], axis=0)
    again = np.zeros(len(order), bool)
    again[order] = start[order] >= stop[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return {"doc": doc, "start": start, "stop": stop, "again": again, "h1": h1.view(np.int64), "h2": h2.astype(np.uint32).view(np.int32)}


def _units(min_words: int, line_words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets, _ = text_buffers(part.column(2))
                u = units(raw, offsets, min_words, line_words)
                rows = pa.array(u["doc"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), *(pa.array(u[k].astype(np.int32)) for k in ("start", "stop")), pa.array(u["again"].astype(bool)), pa.array(u["h1"].astype(np.int64)), pa.array(u["h2"].astype(np.int32))],
                    names=[x.split()[0] for x in _UNITS.split(", ")],
                )

    return run


def spans(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, version, removed): spans that go, in order, each with the document that keeps it.

    ``version`` tells rows of one doc_id with different texts apart.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    cut = scratch.table(narrow.mapInArrow(_units(min_words, line_words), _UNITS), "units")
    held = cut.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("again").alias("within")).where("low < high OR within").select("h1", "h2", "low")
    gone = cut.join(held, ["h1", "h2"]).where("again OR doc_id > low").select("doc_id", "version", "start", "stop", F.col("low").alias("kept_doc_id"))
    row = Window.partitionBy("doc_id", "version").orderBy("start", F.desc("stop"), "kept_doc_id")
    before = F.coalesce(F.max("stop").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = gone.repartition("doc_id", "version").withColumn("before", before).where("stop > before").withColumn("start", F.greatest("start", "before"))
    other = (F.col("start") > F.lag("stop", 1, -1).over(row)) | (F.col("kept_doc_id") != F.lag("kept_doc_id").over(row))
    runs = parts.withColumn("island", F.sum(other.cast("int")).over(row)).groupBy("doc_id", "version", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_doc_id").alias("kept_doc_id"))
    removed = runs.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kept_doc_id"))).alias("removed"))
    out = scratch.table(removed, "removed")
    scratch.drop("units")
    return out


def _remaining(text: str, removed: str) -> F.Column:
    """The text without the removed spans."""
    return F.expr(
        f"""array_join(transform(sequence(0, size({removed})), i -> substring({text},
            if(i = 0, 0, element_at({removed}, greatest(i, 1)).stop) + 1,
            if(i = size({removed}), 2147483647, {removed}[least(i, size({removed}) - 1)].start) - if(i = 0, 0, element_at({removed}, greatest(i, 1)).stop))), '')"""
    )


def _marked(docs: DataFrame, removed: DataFrame, how: str) -> tuple[DataFrame, str]:
    a, b, c = fresh(docs, "__id"), fresh(docs, "__version"), fresh(docs, "__removed")
    right = removed.select(F.col("doc_id").alias(a), F.col("version").alias(b), F.col("removed").alias(c)).hint("shuffle_hash")
    return docs.join(right, (docs["doc_id"] == F.col(a)) & (F.hash(docs["text"]) == F.col(b)), how).drop(a, b), c


def repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, text, removed) of the documents that lose something: what remains, and the spans that went."""
    scratch = Scratch(spark)
    marked, c = _marked(docs.select("doc_id", "text"), spans(scratch, docs, min_words, line_words), "inner")
    return marked.select("doc_id", _remaining("text", c).alias("text"), F.col(c).alias("removed"))


def cleaned(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` without what others hold earlier. n_chars, where there is one, follows the text."""
    scratch = Scratch(spark)
    marked, c = _marked(docs, spans(scratch, docs, min_words, line_words), "left")
    text = F.when(F.col(c).isNull(), F.col("text")).otherwise(_remaining("text", c))
    out = marked.withColumn("text", text).where(F.col(c).isNull() | F.col("text").rlike(r"[\p{L}\p{Nd}]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(c).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, read_table(spark, sf_dir, "documents"))
