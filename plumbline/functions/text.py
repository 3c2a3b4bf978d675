"""Stamps, names and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def stamp(seconds: Column) -> Column:
    """struct<sec, nanosec> with a rounded nanosecond carried; null for negative times."""
    whole = F.floor(seconds)
    nanos = F.round((seconds - whole) * 1e9).cast("bigint")
    carry = (nanos >= 1_000_000_000).cast("bigint")
    return F.when(seconds >= 0, F.struct((whole + carry).alias("sec"), (nanos - carry * 1_000_000_000).alias("nanosec")))


def seconds_from_nanos(ns: Column) -> Column:
    return ns * F.lit(1e-9)


def vtt_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("bigint")
    part = lambda per, limit: (F.floor(ms / per) % limit if limit else F.floor(ms / per)).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), (ms % 1000).cast("bigint"))


def optical_frame(camera: Column) -> Column:
    return F.concat(camera, F.lit("_optical_frame"))


def camera_of_frame(frame_id: Column) -> Column:
    """Camera of an optical frame id; null for other frames."""
    return F.when(frame_id.endswith("_optical_frame"), F.regexp_replace(frame_id, "_optical_frame$", ""))


def is_remote(uri: Column) -> Column:
    return uri.startswith("http://") | uri.startswith("https://")


def resolve_uri(uri: Column, root: Column) -> Column:
    """A member's location: remote and absolute uris as they are, others below root."""
    return F.when(is_remote(uri) | uri.startswith("/"), uri).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), uri))


def relative_uri(uri: Column, root: Column) -> Column:
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(uri.startswith(base), F.substr(uri, F.length(base) + 1)).otherwise(uri)


def yaml_numbers(text: Column, key: str) -> Column:
    """array<double> of ``key: [..]``, which may run over several lines."""
    inside = F.regexp_extract(text, rf"(?s)\b{key}:\s*\[([^\]]*)\]", 1)
    return F.when(inside != "", F.transform(F.split(inside, ","), lambda x: F.trim(x).try_cast("double")))


def yaml_matrix(text: Column, key: str) -> Column:
    """The 16 numbers in ``data: [..]`` below ``key:``; null if there aren't 16."""
    inside = F.regexp_extract(text, rf"(?s)\b{key}:.*?data:\s*\[([^\]]*)\]", 1)
    numbers = F.transform(F.split(inside, r"[,\s]+"), lambda x: x.try_cast("double"))
    numbers = F.filter(numbers, lambda x: x.isNotNull())
    return F.when(F.size(numbers) == 16, numbers)


def guessed_camera(path: Column) -> Column:
    """Name of the known calibration that a recording's path suggests."""
    low = F.lower(path)
    return F.when(low.contains("freiburg1"), "freiburg1").when(low.contains("freiburg2"), "freiburg2").when(low.contains("freiburg3"), "freiburg3").otherwise("default")
