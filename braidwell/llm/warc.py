"""WARC files: a writer, and a reader that splits gzip files anywhere.

Each record of a ``.warc.gz`` is a gzip member of its own, so a file can be entered wherever a member begins,
and nothing in the file says where that is. A task gets a byte range, looks in it for the gzip magic, and
takes a candidate for a member if its header is sound and its first bytes decode to a WARC version line. It
then decodes the member to its end, past the range if need be, and goes on at the byte after it. A task owns
the records whose members start inside its range; ranges cover every file once, so every record has one owner.

A candidate that doesn't decode to the end (a cut or damaged file) gives no record, and the search goes on
one byte later. Within one range, bytes inside a decoded member are never candidates. Only a payload that is
itself a gzipped WARC, stored uncompressed and lying across the beginning of a range, could be taken for a member.

Defined cases: null page_id, url and html come back as null, empty strings as empty; line ends and control
characters in a url are escaped in its header and restored; payloads of any length; repeated rows come back as
often as they were written; an empty table gives no file and no rows. Other columns aren't written.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.llm.common import Scratch, read_table

LEVEL = 1
_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 18
_FIELDS = "path string, start long, stop long, type string, uri string, record_id string, headers map<string,string>, payload binary"


def _open(path: str, mode: str):
    """A file on local disk or in any file system that Arrow knows by its scheme."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner) if mode == "rb" else system.open_output_stream(inner)


def record(page_id, url, html) -> bytes:
    """One resource record, uncompressed."""
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"]
    if url is not None:
        plain = url.isprintable() and url == url.strip() and url
        head.append(f"WARC-Target-URI: {url if plain else quote(url)}")
        head += [] if plain else ["Page-URL-Quoted: yes"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if html is None:
        head.append("Page-Without-Payload: yes")
    body = (html or "").encode()
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_pages(pages: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Write page_id, url and html as one file per partition; (path, length, records) of each file.

    Only files of the tasks that Spark committed are in the returned table: a lost or repeated task's aren't.
    """

    def run(batches):
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        out, length, n = None, 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or _open(path, "wb")
                data = member(record(page_id, url, html), level)
                out.write(data)
                length, n = length + len(data), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([n])], names=["path", "length", "records"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string, length long, records long")


def _decoded(data: bytearray, at: int, more) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends, or None. ``more()`` appends to ``data``; false at the file's end."""
    while len(data) - at < 18 and more():
        pass
    if len(data) - at < 18 or data[at + 3] & 0xE0:  # reserved flags
        return None
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= len(data) and not more():
                return None
            step = bytes(data[pos : pos + (_STEP if out else 4096)])
            out.append(z.decompress(step))
            pos += len(step)
            if len(out) == 1 and out[0] and not (out[0].startswith(b"WARC/") or b"WARC/".startswith(out[0])):
                return None
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def parse(data: bytes):
    """(headers, payload) of each record in a decoded member."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = dict(x.partition(":")[::2] for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        headers = {k.strip(): v.strip() for k, v in headers.items()}
        try:
            size = int(headers.get("Content-Length", ""))
        except ValueError:
            return
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def scan(path: str, start: int, stop: int):
    """(member start, member end, headers, payload) of the records that start in [start, stop) of a file."""
    with _open(path, "rb") as f:
        f.seek(start)
        data, pos = bytearray(f.read(stop - start)), 0

        def more() -> bool:
            step = f.read(_STEP)
            data.extend(step)
            return bool(step)

        while len(data) < stop - start + 2 and more():  # a magic may begin on the range's last byte
            pass
        while True:
            at = data.find(_MAGIC, pos)
            if at < 0 or at >= stop - start:
                return
            got = _decoded(data, at, more)
            if got is None:
                pos = at + 1
                continue
            for headers, payload in parse(got[0]):
                yield start + at, start + got[1], headers, payload
            pos = got[1]


def _read(batches):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    for batch in batches:
        for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            rows, held = [], 0
            for a, b, headers, payload in scan(path, start, stop):
                rows.append((path, a, b, headers.get("WARC-Type"), headers.get("WARC-Target-URI"), headers.get("WARC-Record-ID"), list(headers.items()), payload))
                held += len(payload)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _bytes(spark: SparkSession) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def read_files(files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Records of files given as (path, length), one task per range of ``split_bytes``.

    By default a range is as long as Spark's own for files. Ranges are dealt out round robin.
    """
    size = split_bytes or _bytes(files.sparkSession)
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + F.lit(size), F.col("length")).alias("stop"))
    count = ranges.count()
    return ranges.repartition(max(1, count)).mapInArrow(_read, _FIELDS)


def read_warc(spark: SparkSession, folder: str, split_bytes: int | None = None) -> DataFrame:
    """Records of all ``*.warc.gz`` below a folder. Only names and lengths are listed on the driver's side."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(folder)
    return read_files(found.select("path", "length"), split_bytes)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, url and html as they were written."""
    h = F.col("headers")
    quoted = F.expr("url_decode(replace(coalesce(uri, ''), '+', '%2B'))")
    return records.select(
        h["Page-ID"].cast("long").alias("page_id"),
        F.when(h["Page-URL-Quoted"].isNotNull(), quoted).otherwise(F.col("uri")).alias("url"),
        F.when(h["Page-Without-Payload"].isNull(), F.col("payload").cast("string")).alias("html"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as WARC files in the shared folder and read them back: page_id, url, html."""
    scratch = Scratch(spark)
    target = scratch.path("warc")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    files = scratch.table(write_pages(read_table(spark, sf_dir, "pages"), target), "files")
    return pages_of(read_files(files.select("path", "length")))
