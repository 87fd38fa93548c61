"""Explicit schemas of the landed inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()

PAPER_VERSIONS = T.StructType(
    [
        T.StructField("base_id", _s, False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("probe", _s),  # exists, missing or error
        T.StructField("title", _s),
        T.StructField("authors", T.ArrayType(_s)),
        T.StructField("summary", _s),
        T.StructField("published", T.TimestampType()),
        T.StructField("updated", T.TimestampType()),
        T.StructField("entry_id", _s),
        T.StructField("journal_ref", _s),
    ]
)

#: A map, not a struct: keys that differ in case only both survive.
CITED_WORK = T.StructType(
    [
        T.StructField("paperId", _s),
        T.StructField("title", _s),
        T.StructField("publicationDate", _s),
        T.StructField("externalIds", T.MapType(_s, _s)),
        T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", _s)]))),
    ]
)

CITATIONS = T.StructType(
    [
        T.StructField("base_id", _s, False),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("references", T.ArrayType(CITED_WORK)),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("base_id", _s),
        T.StructField("success", T.BooleanType()),
        T.StructField("versions", T.IntegerType()),
        T.StructField("references", T.IntegerType()),
        T.StructField("error", _s),
        T.StructField("original_size", T.LongType()),
        T.StructField("extracted_size", T.LongType()),
        T.StructField("rss_bytes", T.LongType()),
        T.StructField("finished_at", T.TimestampType()),
    ]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("service", _s),
        T.StructField("key", _s),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("arrived_at", T.TimestampType()),
        T.StructField("outcome", _s),
        T.StructField("backoff_s", T.IntegerType()),
    ]
)
