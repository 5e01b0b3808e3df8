"""String, hash and JSON functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlake.errors import ParseError


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_field(c: Column | str) -> Column:
    """Without white space, tabs and quotes at both ends."""
    return F.regexp_replace(_col(c), '^[ \\t"]+|[ \\t"]+$', "")


def label_hash8(label: Column | str) -> Column:
    """The lossy one-byte label id (xor, then times 31, modulo 256, over the ASCII bytes), for exchange with stores that use it; labels themselves stay strings."""
    codes = F.transform(F.filter(F.split(_col(label), ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda h, b: (h.bitwiseXOR(b) * 31) % 256)


def checksum(c: Column | str) -> Column:
    """CRC-32 (polynomial EDB88320)."""
    return F.crc32(_col(c))


def json_valid(c: Column | str) -> Column:
    return F.coalesce(F.try_parse_json(_col(c)).isNotNull(), F.lit(False))


def json_get(c: Column | str, path: str, kind: str) -> Column:
    """A value of a JSON text by path and Spark type; null if it is not there or of another kind."""
    return F.try_variant_get(F.try_parse_json(_col(c)), path, kind)


def json_has(c: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_col(c)), key), F.lit(False))


def json_size(c: Column | str) -> Column:
    """Elements of an array, or keys of an object."""
    return F.coalesce(F.json_array_length(_col(c)), F.size(F.json_object_keys(_col(c))))


def parse_json(text: str) -> object:
    """One JSON document on the driver; ParseError says where it breaks."""
    import json

    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ParseError(f"{e.msg} at {e.pos}") from e
