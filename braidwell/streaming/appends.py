"""Append-only logs as a source: complete lines with their byte positions, from where the last reader stopped.

Spark's own file stream reads a file once and never opens it again; a log grows at its end. The offset here is a byte
position per file. An unfinished last line waits until it is ended. Appended bytes are cut into ranges, one a task, and
a task owns the lines that begin inside its range, so a log that was never read before is read by all cores.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "braidwell_log"
COLUMNS = "part int, file string, position long, value string"
SPLIT = 64 << 20
_STEP = 1 << 20


def _system(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def _files(paths: list[str]) -> dict[str, int]:
    """Files below the paths, each with the number of its path; those of a folder by name. Hidden names and what a writer has not committed are left out."""
    out = {}
    for part, path in enumerate(paths):
        system, inner = _system(path)
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and not any(x[:1] in "._" for x in f.path[len(inner) :].split("/") if x):
                out.setdefault(path if f.path == inner else path.rstrip("/") + f.path[len(inner.rstrip("/")) :], part)
    return out


def _end(path: str) -> int:
    """The byte after the last line end of a file."""
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        stop = f.size()
        while stop > 0:
            start = max(0, stop - _STEP)
            f.seek(start)
            at = f.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def lines(path: str, start: int, stop: int, first: int):
    """(positions, lines) in blocks, of the lines of a file that begin in [start, stop). ``first``: where a line is known to begin."""
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        at = start if start == first else start - 1  # a line begins at start if the byte before ends one
        f.seek(at)
        skip, rest = start != first, b""
        while at < stop:
            block = f.read(_STEP)
            if not block:
                return
            rest += block
            cut = rest.rfind(b"\n") + 1
            if not cut:
                continue
            places, values = [], []
            for line in rest[:cut].split(b"\n")[:-1]:
                if skip:
                    skip = False
                elif at < stop:
                    places.append(at)
                    values.append(line[:-1] if line.endswith(b"\r") else line)
                at += len(line) + 1
            rest = rest[cut:]
            if places:
                yield places, values


class Range(InputPartition):
    def __init__(self, part: int, file: str, start: int, stop: int, first: int):
        super().__init__((part, file, start, stop, first))


def _ranges(files: dict[str, int], begin: dict[str, int], end: dict[str, int], split: int) -> list[Range]:
    return [Range(files.get(f, 0), f, a, min(a + split, stop), begin.get(f, 0)) for f, stop in end.items() for a in range(begin.get(f, 0), stop, split)]


def _batches(partition: Range):
    part, file, start, stop, first = partition.value
    for places, values in lines(file, start, stop, first):
        n = len(places)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([file] * n), pa.array(places, pa.int64()), pa.array([v.decode("utf-8", "replace") for v in values])], names=["part", "file", "position", "value"])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self):
        files = _files(self.paths)
        return _ranges(files, {}, {f: _end(f) for f in files}, self.split)

    def read(self, partition):
        return _batches(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {f: _end(f) for f in _files(self.paths)}

    def partitions(self, start, end):
        return _ranges(_files(self.paths), start, end, self.split)

    def read(self, partition):
        return _batches(partition)


class LogSource(DataSource):
    """format("braidwell_log"): ``paths``, a JSON list of files and folders in log order, and ``splitBytes``."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return COLUMNS

    def _asked(self):
        return json.loads(self.options["paths"]), int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema):
        return _Reader(*self._asked())

    def streamReader(self, schema):
        return _StreamReader(*self._asked())


def _reader(of, paths: str | list[str], split: int):
    return of.format(NAME).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("splitBytes", str(split))


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning happens in a Python of its own
    spark.dataSource.register(LogSource)


def read_lines(spark: SparkSession, paths: str | list[str], split: int = SPLIT) -> DataFrame:
    """part, file, position and value of every complete line."""
    register(spark)
    return _reader(spark.read, paths, split).load()


def stream_lines(spark: SparkSession, paths: str | list[str], split: int = SPLIT) -> DataFrame:
    """The same as a stream that goes on where its checkpoint says."""
    register(spark)
    return _reader(spark.readStream, paths, split).load()


def sizes(paths: str | list[str]) -> dict[str, int]:
    """Bytes of each file of a log."""
    out = {}
    for f in _files([paths] if isinstance(paths, str) else list(paths)):
        system, inner = _system(f)
        out[f] = system.get_file_info(inner).size
    return out


def append_lines(rows: DataFrame, folder: str, key: str, files: int) -> int:
    """Append column ``value`` to ``files`` logs of a folder, each row to the log its ``key`` falls to, in the order of
    ``key``; one task a log. A repeated task may repeat its lines, as with any log: readers keep the last of each identity."""

    def run(batches):
        n, out, at = 0, None, None
        for batch in batches:
            for place, value in zip(*(c.to_pylist() for c in batch.columns)):
                if place != at:
                    if out is not None:
                        out.close()
                    system, inner = _system(folder)
                    system.create_dir(inner, recursive=True)
                    at, path = place, f"{inner}/{place}.jsonl"
                    out = open(path, "ab") if isinstance(system, fs.LocalFileSystem) else system.open_append_stream(path)
                out.write(value.encode() + b"\n")
                n += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    placed = rows.select(F.pmod(F.col(key), F.lit(files)).cast("int").alias("place"), "value", key)
    dealt = placed.repartitionByRange(files, "place").sortWithinPartitions("place", key).select("place", "value")
    return dealt.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
