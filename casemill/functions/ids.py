"""Deterministic ids and digests, as columns."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a text in a namespace, lower case; null for null."""
    raw = F.sha1(F.concat(F.unhex(F.lit(UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab" * 4]), F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def canonical_json(dims: Column) -> Column:
    """A string map as JSON with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(dims))))


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def canonical_decimal(value: Column) -> Column:
    """Fixed-point text without trailing zeros: 12.5000 is 12.5, 3.00 is 3."""
    text = F.format_string("%s", value.cast("decimal(38,10)"))
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def payload_hash(**fields: Column) -> Column:
    """SHA-256 of typed values as JSON, names sorted: decimals in fixed point, dates as ISO, nulls kept."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(fields[k].cast("string"))), F.lit("[null]"))) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def fingerprint(rows: Column) -> Column:
    """Aggregate: SHA-256 of the sorted texts of a group."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(rows)), "\n"), 256)
