"""Record keys: ``space/table/record.json``, and what their segments may be."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

SEGMENT = r"^[A-Za-z0-9._:-]{1,128}$"
_SEGMENT = re.compile(SEGMENT.replace("$", r"\Z"))
#: Fixed alphabet of ULIDs.
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def check(*segments: str) -> None:
    for x in segments:
        if not _SEGMENT.match(x):
            raise InvalidArgument(f"not a key segment (1 to 128 of A-Z a-z 0-9 . _ : -): {x!r}")


def valid(segment: Column) -> Column:
    return F.coalesce(segment.rlike(SEGMENT) & ~segment.contains("\n"), F.lit(False))


def record_key(space: Column, table: Column, record_id: Column) -> Column:
    return F.concat(F.concat_ws("/", space, table, record_id), F.lit(".json"))


def parse_record_key(key: Column) -> Column:
    """struct<space,table_name,record_id>, null if it isn't such a key."""
    form = r"^([^/]+)/([^/]+)/(.+)\.json$"
    part = lambda i: F.regexp_extract(key, form, i)
    return F.when(key.rlike(form), F.struct(part(1).alias("space"), part(2).alias("table_name"), part(3).alias("record_id")))


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 24)


def ulid(now_ms: int | None = None) -> str:
    """26 characters that sort by time."""
    value = (int(time.time() * 1000) if now_ms is None else now_ms) << 80 | int.from_bytes(os.urandom(10))
    return "".join(_BASE32[value >> 5 * i & 31] for i in range(25, -1, -1))
