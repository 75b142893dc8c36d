"""A corpus of text files: scan, watermark, reading with counted rejects, and generations of its index."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.functions import text as X
from braidwell.operators.documents import Index, index_of, laid_out

MOST_BYTES = 1 << 20
SUFFIXES = ("md", "markdown")
SKIP = r"(?:^|/)(?:\.[^/]*|node_modules)(?:/|$)"


def scan(spark: SparkSession, root: str, suffixes=SUFFIXES, skip: str = SKIP, content: bool = True) -> DataFrame:
    """path below root, size, mod_time and content of the files wanted. Without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    place = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + __import__("re").escape(place) + "/", "")
    out = files.withColumn("path", below).where(~F.col("path").rlike(skip))
    return out.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), *(["content"] if content else []))


def watermark(files: DataFrame, settings: str = "", revision: str = "") -> DataFrame:
    """One hash of settings, revision and every (path, size, mod_time): equal exactly while nothing changed."""
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), F.unix_micros("mod_time").cast("string"))
    return files.agg(F.sha2(F.concat_ws("\n", F.lit(settings), F.lit(revision), F.array_join(F.array_sort(F.collect_list(line)), "\n")), 256).alias("watermark"))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, failures): files that are too large, not UTF-8 or hold NUL bytes are counted, not fatal."""
    whole = F.col("content").cast("string")
    reason = F.when(F.col("size") > MOST_BYTES, F.lit("too_large")).when(~F.is_valid_utf8(whole), F.lit("not_utf8")).when(F.instr(F.hex("content"), "00") > 0, F.when(F.contains(whole, F.lit("\0")), F.lit("nul")))
    judged = files.withColumn("reason", reason)
    docs = judged.where("reason IS NULL").select("path", "size", "mod_time", whole.alias("text"), X.project_of(F.col("path")).alias("project"), X.digest(whole).alias("revision"))
    return docs, judged.where("reason IS NOT NULL").select("path", "reason")


class Generations:
    """Numbered copies of an index below a folder, one of them current.

    A generation is written in full under a name made of its number and content digest; then a pointer file is
    replaced. Readers follow the pointer, so they see the old generation or the new one and never a part.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("gen-"))

    def current(self) -> str | None:
        at = self._path(f"{self.root}/current")
        return self.spark.read.text(f"{self.root}/current").first()[0] if self._fs.exists(at) else None

    def write(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], header: dict) -> str:
        """Write tables and header as a new generation and make it current. Row counts are kept to be checked on load. A table may be
        made from those before it as they were written."""
        number = int(self.names()[-1].split("-")[1]) + 1 if self.names() else 1
        stage = f"{self.root}/.staged-{number:06d}"
        written: dict[str, DataFrame] = {}
        for name, made in tables.items():
            df = made(written) if callable(made) else made
            df.write.mode("overwrite").parquet(f"{stage}/{name}")
            written[name] = self.spark.read.schema(df.schema).parquet(f"{stage}/{name}")
        counts = {name: self.spark.read.parquet(f"{stage}/{name}").count() for name in tables}
        from hashlib import sha256

        digest = sha256(json.dumps([header, counts], sort_keys=True).encode()).hexdigest()[:12]
        name = f"gen-{number:06d}-{digest}"
        self._put(f"{stage}/trailer.json", json.dumps({"header": header, "counts": counts}))
        self._fs.rename(self._path(stage), self._path(f"{self.root}/{name}"))
        self.publish(name)
        return name

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, name: str) -> None:
        self._put(f"{self.root}/.current", name)
        self._fs.delete(self._path(f"{self.root}/current"), False)
        self._fs.rename(self._path(f"{self.root}/.current"), self._path(f"{self.root}/current"))

    def prune(self, keep: int = 1) -> list[str]:
        """Delete all but the newest ``keep`` generations and the current one."""
        now, gone = self.current(), []
        for name in self.names()[: -keep or None]:
            if name != now:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
                gone.append(name)
        return gone

    def load(self, name: str | None = None) -> tuple[dict[str, DataFrame], dict]:
        """(tables, header) of a generation; fails where a trailer is missing or counts differ."""
        name = name or self.current()
        if name is None:
            raise FileNotFoundError(f"{self.root} has no current generation")
        at = f"{self.root}/{name}"
        trailer = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{at}/trailer.json").collect()))
        tables = {t: self.spark.read.parquet(f"{at}/{t}") for t in trailer["counts"]}
        for t, n in trailer["counts"].items():
            if tables[t].count() != n:
                raise ValueError(f"{name}: {t} doesn't hold the {n} rows it was written with")
        return tables, trailer["header"]


def mark_of(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of a table's files: what an index was built from."""
    from hashlib import sha256

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sha256(json.dumps(sorted([f.getPath().getName(), f.getLen(), f.getModificationTime()] for f in files)).encode()).hexdigest()[:16]


def stored_index(spark: SparkSession, root: str, mark: str, build) -> tuple[Index, bool]:
    """The index below ``root``, and whether it had to be built: a new generation is written where the current one wasn't
    made from ``mark``, and all but the last two are deleted. Searches of any session then read the same tables."""
    kept = Generations(spark, root)
    if kept.current() is not None:
        tables, header = kept.load()
        if header.get("mark") == mark:
            return Index(tables["postings"], index_of(tables["postings"]).lengths, tables["vocabulary"], tables["stats"]), False
    counted = lambda t: index_of(t["postings"])
    kept.write({"postings": laid_out(build().postings), "vocabulary": lambda t: counted(t).vocabulary, "stats": lambda t: counted(t).stats}, {"mark": mark})
    kept.prune(2)
    return stored_index(spark, root, mark, build)[0], True


def notes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, refused) of notes: ``key: value`` lines, a blank line, a body cut at ``## `` headings.

    A note needs a readable RFC 3339 date. sections: note_id, ordinal, title, heading, tags, body, event_time.
    """
    whole = F.col("text")
    head, body = F.regexp_extract(whole, r"(?s)^((?:[A-Za-z_-]+:[^\n]*\n)+)", 1), F.regexp_replace(whole, r"(?s)^(?:[A-Za-z_-]+:[^\n]*\n)+\n?", "")
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.split(x, ":", 2)[0])), F.trim(F.split(x, ":", 2)[1]))))
    at = F.try_to_timestamp(F.try_element_at("fields", F.lit("date")))
    n = files.withColumn("fields", fields).withColumn("body", body).withColumn("event_time", at)
    n = n.withColumn("reason", F.when(F.try_element_at("fields", F.lit("date")).isNull(), F.lit("no_date")).when(F.col("event_time").isNull(), F.lit("bad_date")))
    good = n.where("reason IS NULL").select("note_id", "fields", "event_time", F.posexplode(F.split("body", "\n(?=## )")).alias("ordinal", "part"))
    heading = F.regexp_extract("part", r"^## ([^\n]*)", 1)
    sections = good.select(
        "note_id", "ordinal", F.try_element_at("fields", F.lit("title")).alias("title"), heading.alias("heading"),
        F.coalesce(F.try_element_at("fields", F.lit("tags")), F.lit("")).alias("tags"), X.stripped(F.regexp_replace("part", r"^## [^\n]*\n?", "")).alias("body"), "event_time",
    )
    return sections, n.where("reason IS NOT NULL").select("note_id", "reason")
