"""Markdown that no regular expression can cut: sections, link destinations and excerpts, in Arrow batches.

The functions work on one text each and are wrapped as Arrow and Pandas UDFs; they touch only the columns they need, and
excerpts are made after the cut to the results shown.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from braidwell.functions import text as X
from braidwell.functions.analyze import query_tokens
from braidwell.schema import ddl

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?=[ \t]|$)(.*)$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
EXCERPT, LEAD = 400, 100


def sections(text: str) -> list[dict]:
    """Sections by ATX headings; fenced blocks are opaque. Lines count from 1; a section without body ends at its heading."""
    lines, out, stack = text.split("\n"), [], []
    fence, begin, heading, path = "", 0, None, []

    def close(end: int) -> None:
        first = begin + (heading is not None)
        while end > first and not lines[end - 1].strip():
            end -= 1
        body = lines[min(first, end) : end]
        if heading is not None or body:
            out.append({"ord": len(out), "heading": heading or "", "path": list(path), "start_line": begin + 1, "end_line": first + len(body), "body": "\n".join(body)})

    for i, line in enumerate(lines):
        mark = _FENCE.match(line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1].startswith(fence):
                fence = ""
            continue
        found = None if fence else _HEADING.match(line)
        if not found:
            continue
        close(i)
        level, name = len(found[1]), found[2].strip().rstrip("#").strip()
        stack = [(n, s) for n, s in stack if n < level] + [(level, name)]
        begin, heading, path = i, line, [s for _, s in stack]
    close(len(lines))
    return out


def without_link_targets(text: str) -> str:
    """``[label](target)`` without the target, whose parentheses may nest; escaped brackets stay."""
    out, at = [], 0
    while True:
        i = text.find("](", at)
        if i < 0:
            return "".join([*out, text[at:]])
        depth, j, end = 0, i + 1, -1
        if not (i and text[i - 1] == "\\"):
            while j < len(text) and text[j] != "\n":
                if text[j] == "\\":
                    j += 1
                elif text[j] == "(":
                    depth += 1
                elif text[j] == ")":
                    depth -= 1
                    if not depth:
                        end = j
                        break
                j += 1
        if end < 0:
            out.append(text[at : i + 1])
            at = i + 1
        else:
            out += [text[at:i], "] "]
            at = end + 1


_REFERENCE = re.compile(r"^([ \t]*\[[^\n]*?[^\n]\]:)[ \t]*\S+", re.M)
_RUN = re.compile(r"[^\s 　–—…|<>\",;]+")
_LOCATOR = re.compile(r"(?i)^(?:[a-z][a-z0-9+.-]*://\S*|www\.\S+|mailto:\S+|(?:[a-z0-9-]+\.)+(?:com|org|net|io|dev|edu|gov)(?:[/:?#]\S*)?)$")


def without_locators(text: str) -> str:
    """Without link targets, reference definitions' targets, URLs and bare host names: none is what a text is about."""
    text = _REFERENCE.sub(r"\1 ", without_link_targets(text))
    return _RUN.sub(lambda m: " " if _LOCATOR.match(m[0].strip("\"'*_`!?.,:;{}[]()<>")) else m[0], text)


def excerpt(body: str, terms: set[str], most: int = EXCERPT, lead: int = LEAD) -> str | None:
    """The first window of whole lines that holds the most distinct terms, at most ``most`` characters; None without a match."""
    lines = [s for s in (x.strip() for x in body.split("\n")) if s]
    hits = [[t for t, _ in query_tokens(x.replace('"', " ")) if t in terms] for x in lines]

    def extend(start: int) -> tuple[int, set[str]]:
        width, seen, j = 0, set(), start
        while j < len(lines):
            wider = width + len(lines[j]) + (j > start)
            if j > start and wider > most:
                break
            width, seen, j = wider, seen.union(hits[j]), j + 1
        return j, seen

    best, span = 0, None
    for i in range(len(lines)):
        if not hits[i]:
            continue
        start, used = i, 0
        while start > 0 and used + len(lines[start - 1]) + 1 <= lead:
            start -= 1
            used += len(lines[start]) + 1
        end, seen = extend(start)
        if end <= i:
            start = i
            end, seen = extend(i)
        if len(seen) > best:
            best, span = len(seen), (start, end)
    if span is None:
        return None
    text = " ".join(lines[span[0] : span[1]])
    if len(text) <= most:
        return text
    first = next((m.start() for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in terms), 0)
    keep = most - 2
    at = min(max(0, first - most // 4), len(text) - keep)
    return ("…" if at else "") + text[at : at + keep] + ("…" if at + keep < len(text) else "")


SLICE = 2 << 20


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows that hold ``most`` bytes together, or are one row."""
    begin, held = 0, 0
    for end, size in enumerate([*sizes, most + 1]):
        if end > begin and held + size > most:
            yield begin, end
            begin, held = end, 0
        held += size


def by_slices(column: pa.Array, f: Callable[[str], object], kind: pa.DataType, most: int = SLICE) -> pa.Array:
    """``f`` of every text (null for null), made for texts of ``most`` bytes at a time: a batch of 10,000 long texts is never a batch
    of Python objects, so a worker's memory is that of the batch's bytes before and after."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    out = [pa.array([None if t is None else f(t) for t in column.slice(a, b - a).to_pylist()], kind) for a, b in slices(sizes, most)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


_SECTIONS = ddl("x array<struct<ord:int,heading:string,path:array<string>,start_line:int,end_line:int,body:string>>")["x"].dataType


@F.arrow_udf(_SECTIONS)
def sections_udf(text: pa.Array) -> pa.Array:
    return by_slices(pc.fill_null(text, ""), sections, to_arrow_type(_SECTIONS))


@F.arrow_udf(T.StringType())
def without_locators_udf(text: pa.Array) -> pa.Array:
    return by_slices(text, without_locators, pa.string())


@F.pandas_udf(T.StringType())
def excerpt_udf(body: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or t is None else excerpt(b, set(t)) for b, t in zip(body, terms)], dtype=object)


def chunked(docs: DataFrame, key: str, text: str = "text", stem: Column | None = None) -> DataFrame:
    """One row per section: key, chunk fields, title, the text that is indexed (path and body without locators),
    what of it is quoted, fingerprint and digest."""
    each = docs.withColumn("__s", F.explode(sections_udf(F.col(text)))).select(*docs.drop(text).columns, "__s.*")
    from pyspark.sql import Window

    own = F.when((F.size("path") == 1) & F.col("heading").rlike("^ {0,3}#(?:[ \t]|$)"), F.get("path", F.lit(0)))
    name = F.first(own, ignorenulls=True).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = each.withColumn("doc_title", F.coalesce(name, stem if stem is not None else F.col(key).cast("string")))
    indexed = without_locators_udf(F.concat_ws("\n", F.array_join("path", " "), "body"))
    return each.withColumns({
        "title": X.chunk_title(F.col("doc_title"), F.col("path")), "indexed": indexed, "cited": without_locators_udf(X.quoted_runs(F.col("body"))),
        "content_fingerprint": X.fingerprint(F.concat_ws("\n", F.array_join("path", " "), "body")), "revision": X.digest(F.col("body")),
    })
