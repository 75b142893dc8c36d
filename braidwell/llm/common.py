"""What the corpus operators share: table access, intermediate tables and Arrow text buffers.

Intermediate results are Parquet tables in the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import atexit
import shutil
import unicodedata
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.shared import shared_dir, spread


_roots: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    for root, spark in _roots.items():
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().isStopped() is False:
            _delete(spark, root)
        elif root.startswith("file:"):  # the session ended before the process
            shutil.rmtree(urlparse(root).path, ignore_errors=True)


class Scratch:
    """Intermediate tables of one query. They last as long as the process: results read them lazily.

    Large ones are dropped by the query that wrote them as soon as nothing reads them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        _roots[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a scan: later steps don't recompute it and its lineage ends."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, its few splits dealt out to all cores where there are fewer of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def drop_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids`` (a narrow table); null ids stay.

    The narrow side is hashed, so the texts are shuffled once and never sorted; where the ids are few
    Spark turns it into a broadcast by their measured size.
    """
    key = fresh(docs, "__id")
    return docs.join(ids.select(F.col(column).alias(key)).hint("shuffle_hash"), docs[column] == F.col(key), "left_anti")


def keep_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (a narrow table)."""
    key = fresh(docs, "__id")
    return docs.join(ids.select(F.col(column).alias(key)).hint("shuffle_hash"), docs[column] == F.col(key), "left_semi")


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 21):
    """The batch in slices of whole rows with about ``most`` bytes of text: bounds what numpy holds."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets, _ = text_buffers(column)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, n+1 offsets and validity of a string column, without copying. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    n = len(column)
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not valid.all():  # a null slot may still span bytes
        lengths = np.where(valid, np.diff(offsets), 0)
        if lengths.sum() != len(raw):
            keep = np.repeat(valid, np.diff(offsets))
            raw = raw[keep]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    return raw, offsets, valid


_U = np.uint64
_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) * _U(2) + _U(1)
_WORD = np.zeros(256, bool)
for _r in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_r[0] : _r[1]] = True
_CODE[65:91] = _CODE[97:123]
_CODE[~_WORD] = 0
_MARK, _STOP = 16, 32
HAN, THAI = 2, 4  # kinds of words; 1: of letters and digits in scripts that write spaces
_PAIRED = ((0x3005, 0x3008), (0x3021, 0x3036), (0x3040, 0x3100), (0x3105, 0x3130), (0x31A0, 0x31C0), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x323B0))
_UNSPACED = ((0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0), (0xA980, 0xAA00), (0xAA60, 0xAA80))
_STOPS = "\u0589\u061f\u06d4\u0964\u0965\u0f0d\u0f0e\u104a\u104b\u1362\u1367\u1368\u17d4\u17d5\u2026\u2028\u2029\u203c\u2047\u2048\u2049\u3002\uff01\uff0e\uff1f\uff61"
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """By code point: 0 for punctuation, symbols and space; else 1, HAN or THAI; with _MARK for marks and joiners, _STOP for sentence stops."""
    if not _KINDS:
        out = np.ones(0x110000, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))
            if c[0] in "PSZ" or c == "Cc":
                out[i] = 0
            elif c[0] == "M" or c == "Cf":
                out[i] |= _MARK
        for kind, ranges in ((HAN, _PAIRED), (THAI, _UNSPACED)):
            for a, b in ranges:
                out[a:b][out[a:b] == 1] = kind
        out[[ord(c) for c in _STOPS]] = _STOP
        _KINDS.append(out)
    return _KINDS[0]


_BASE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        n = max(n, 1 << 18)
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _TABLES[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _TABLES[0], _TABLES[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = h + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with two-byte Latin capitals (C3 80..9E) made small; ASCII case folds in the hash codes."""
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if not len(lead):
        return raw
    second = raw[lead + 1]
    up = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    out = raw.copy()
    out[lead[up] + 1] += 0x20
    return out


class Words:
    """Words of a batch of texts: runs of ASCII letters and digits and of all bytes above 127 or, ``by_class``, of
    letters, digits and marks by Unicode's classes. Then, in scripts written without spaces (Han, Kana, Thai, Lao,
    Khmer, Burmese and others), every letter with its marks is a word.

    starts, ends: byte positions in ``raw``; doc: the text each belongs to; first: n+1 word offsets by text;
    kind: 1, HAN or THAI by word; stops: byte positions of sentence stops beyond ASCII.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, by_class: bool = False):
        self.raw, self.offsets = raw, offsets
        is_word = _WORD[raw]
        lead = np.flatnonzero(raw >= 0xC0) if by_class else np.zeros(0, np.int64)
        if len(lead):
            b = raw[lead].astype(np.int32)
            tail = [raw[np.minimum(lead + i, len(raw) - 1)].astype(np.int32) & 63 for i in (1, 2, 3)]
            wide = 2 + (b >= 0xE0) + (b >= 0xF0)
            point = np.select([wide == 2, wide == 3], [(b & 31) << 6 | tail[0], (b & 15) << 12 | tail[0] << 6 | tail[1]], (b & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])
            kind = kinds()[point]
            for i in range(4):
                is_word[(lead + i)[((kind & (_STOP - 1)) == 0) & (i < wide)]] = False
        begin, end = is_word.copy(), is_word.copy()
        if len(raw):
            begin[1:] &= ~is_word[:-1]
            end[:-1] &= ~is_word[1:]
            edges = offsets[(offsets > 0) & (offsets < len(raw))]
            begin[edges] = is_word[edges]
            end[edges - 1] = is_word[edges - 1]
        self.stops = np.zeros(0, np.int64)
        apart = np.zeros(0, np.int64)
        if len(lead):
            self.stops = lead[kind == _STOP]
            mark = (kind & _MARK) > 0
            if (kind & (HAN | THAI)).any():
                joined = np.concatenate([[False], lead[1:] == (lead + wide)[:-1]])
                base = kind[np.maximum.accumulate(np.where(mark & joined, 0, np.arange(len(lead))))]  # marks belong to the letter before
                own = (kind & (HAN | THAI)) > 0
                apart = lead[own]
                after = (lead + wide)[(base & (HAN | THAI)) > 0]
                after = after[after < len(raw)]
                after = after[is_word[after] & ~np.isin(after, lead[mark])]
                at = np.concatenate([apart, after])
                begin[at] = True
                at = at[at > 0] - 1
                end[at] |= is_word[at]
        self.is_word = is_word
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.kind = np.ones(len(self.starts), np.uint8)
        if len(apart):
            self.kind[np.searchsorted(self.starts, apart)] = kind[own]
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, without case, the same wherever it stands."""
        raw, starts, out = folded(self.raw), self.starts, np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(starts):
            base = starts[at]
            end = max(int(np.searchsorted(starts, base + (1 << 18))), at + 1)
            stop = starts[end] if end < len(starts) else len(raw)
            if end - at > 1 and stop - base > (1 << 18):
                end -= 1
                stop = starts[end]
            up, down = _powers(int(stop - base))
            codes = _CODE[raw[base:stop]]
            codes[~self.is_word[base:stop]] = 0
            codes *= up[: stop - base]
            own = starts[at:end] - base
            out[at:end] = np.add.reduceat(codes, own) * down[own]
            at = end
        return mix(out)


def char_positions(raw: np.ndarray) -> np.ndarray:
    """n+1 entries: how many characters begin before each byte."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
