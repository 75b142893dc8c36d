"""Token ids and lengths under a public byte-level BPE vocabulary, read from a path on the workers."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG = 1 << 20
_loaded: dict = {}


def encoder(path: str = VOCABULARY):
    """The vocabulary at ``path``, loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def parts(text: str, most: int = _LONG):
    """A long text in parts whose tokens are those of the whole: no token spans a character before a space."""
    at = 0
    while len(text) - at > most:
        cut = re.compile(r"(?<=\S)(?=\s)").search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    e = encoder(path)
    if len(text) <= _LONG:
        return e.encode_ordinary(text)
    return [t for p in parts(text) for t in e.encode_ordinary(p)]


def with_lengths(docs: DataFrame, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """``columns`` and n_tokens of every row; a null text has none. The text itself isn't carried on."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema.fields)

    def run(batches):
        e = encoder(path)
        for batch in batches:
            n = [0 if t is None else len(e.encode_ordinary(t)) if len(t) <= _LONG else sum(len(e.encode_ordinary(p)) for p in parts(t)) for t in (x.as_py() for x in batch.column(len(columns)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, f"{fields}, n_tokens long")
