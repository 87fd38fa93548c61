"""Column functions: keys, falsy values, times and ratios. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_id(number: Column, prefix: str) -> Column:
    """Paper key with at least five digits; longer numbers keep all of theirs."""
    return F.format_string(f"{prefix}.%05d", number)


def folder_key(key: Column) -> Column:
    return F.replace(key, F.lit("."), F.lit("-"))


def versioned_id(key: Column, version: Column) -> Column:
    return F.concat(key, F.lit("v"), version.cast("string"))


def archive_name(key: Column, version: Column) -> Column:
    return F.concat(versioned_id(key, version), F.lit(".tar.gz"))


def version_folder(key: Column, version: Column) -> Column:
    return versioned_id(folder_key(key), version)


def source_folder(root: str, key: Column, version: Column) -> Column:
    return F.concat_ws("/", F.lit(root), folder_key(key), F.lit("tex"), version_folder(key, version))


def service_url(template: str, key: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{}"), key)


def strip_version(key: Column) -> Column:
    """The key without a version at its end; other letters v stay."""
    return F.regexp_replace(key, "v[0-9]+$", "")


def strip_version_at_first_v(key: Column) -> Column:
    """Everything before the first v, as older outputs have it: keys of names with a v collide."""
    return F.substring_index(key, "v", 1)


def truthy(text: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(text, F.lit(""))


def first_truthy(*texts: Column) -> Column:
    return F.coalesce(*[truthy(t) for t in texts])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def iso_time(at: Column) -> Column:
    """ISO 8601 with an offset; microseconds only where there are any; null stays null."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.unix_micros(at) % 1_000_000 == 0, whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def backoff_seconds(attempt: Column) -> Column:
    """2 to the power of the attempt."""
    return F.call_function("shiftleft", F.lit(1), attempt.cast("int"))


def is_gzip(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 2) == F.lit(bytes.fromhex("1f8b")), F.lit(False))


def has_extension(name: Column, *extensions: str) -> Column:
    """Whether the lower-cased name ends in one of the extensions."""
    return F.lower(name).rlike(r"\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$")
