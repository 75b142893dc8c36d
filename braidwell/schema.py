"""Row types and finite vocabularies that all operators share."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "float": T.FloatType()}


def _parts(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _type(text: str) -> T.DataType:
    text = text.strip()
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("map<"):
        return T.MapType(*map(_type, _parts(text[4:-1])))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n.strip(), _type(t)) for n, _, t in (x.partition(":") for x in _parts(text[7:-1]))])
    return _PLAIN[text]


def ddl(text: str) -> T.StructType:
    """A StructType from ``name type, ...``, without a session (workers import this too)."""
    return T.StructType([T.StructField(n.strip("`"), _type(t)) for n, _, t in (x.partition(" ") for x in _parts(" ".join(text.split())))])


CANDIDATE = ddl(
    """query_id long, source_uid string, source_id string, candidate_id string, source_record_id string, local string,
    derived_from array<string>, record_type string, title string, excerpt string, excerpt_kind string, local_rank int,
    local_score double, relevance double, match_signals array<string>, observed_at timestamp, confirmed_at timestamp,
    event_time timestamp, valid_from timestamp, valid_to timestamp, source_revision string, sensitivity int,
    metadata map<string,string>, entity_id string, entity_type string, aliases array<string>, content_fingerprint string"""
)
QUERY = ddl(
    """query_id long, query string, query_class string, stable_identifiers array<string>, limit int, mode string,
    suppress_lineages array<string>, as_of timestamp, since timestamp, until timestamp, record_types array<string>,
    entities array<string>, project string"""
)
SOURCE = ddl(
    """source_uid string, source_id string, adapter string, location string, enabled boolean, base_prior double,
    intent_priors map<string,double>, sensitivity int, derives_from string, record_types array<string>, timeout_ms long,
    freshness_mode string, as_of_support string, relevance_basis string"""
)
RESULT = ddl(
    """query_id long, position int, lineage_root string, source_uid string, source_id string, local string, candidate_id string,
    title string, excerpt string, excerpt_kind string, score double, exact_promoted boolean, independent_units int,
    cap_applied boolean, local_rank int, pool_size int, prior double, relevance double, members array<string>, sources array<string>"""
)
SUPPRESSION = ddl("query_id long, reason string, count int, lineage_root string, fused_into string")

OUTCOMES = ("answered", "abstained", "failed")
COVERAGES = ("complete", "degraded")
SEARCH_OUTCOMES = tuple("denied failed partial skipped success timeout unavailable".split())
HEALTHS = tuple("healthy degraded unavailable denied".split())
SIGNALS = tuple("alias exact_identifier field lexical semantic".split())
SENSITIVITIES = ("public", "internal", "confidential", "restricted")
SUPPRESSIONS = ("relevance_floor", "lineage_seen", "duplicate", "duplicate_view", "diversity", "sensitivity_ceiling")
QUIET_SKIPS = ("disabled", "not_applicable", "out_of_scope", "record_type_mismatch", "sensitivity_ceiling")
CLASS_IDENTIFIER, CLASS_NATURAL = "identifier_query", "natural_language"

RANK_CONSTANT = 60.0
CORROBORATION_CAP = 2.0
RELEVANCE_FLOOR = 0.10
LIMIT = 20


def conform(df, schema: T.StructType):
    """``df`` with exactly the columns of ``schema``: missing ones are null, types are cast."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
