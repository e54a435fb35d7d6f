"""Queries over a snapshot: all of a list of filters, one sort path, offset and limit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import jsonexpr

OPS = ("eq", "ne", "gt", "ge", "lt", "le", "contains", "exists")


@dataclass(frozen=True)
class Filter:
    """``op`` on the value at ``path``. ``ne`` holds where there is none; ordered ops don't.

    In order, values of different kinds are equal (so ``ge`` and ``le`` hold) and null is below all others.
    """

    op: str
    path: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise InvalidArgument(f"unknown filter op {self.op!r}")
        if self.op == "contains" and not isinstance(self.value, str):
            raise InvalidArgument("contains needs a string")

    def column(self, body: Column) -> Column:
        if self.op == "eq":
            return jsonexpr.equals(body, self.path, self.value)
        if self.op == "ne":
            return ~jsonexpr.equals(body, self.path, self.value)
        if self.op == "exists":
            return jsonexpr.exists(body, self.path)
        if self.op == "contains":
            return jsonexpr.contains(body, self.path, self.value)
        cmp = jsonexpr.order(body, self.path, self.value)
        return F.coalesce({"gt": cmp > 0, "ge": cmp >= 0, "lt": cmp < 0, "le": cmp <= 0}[self.op], F.lit(False))


@dataclass(frozen=True)
class OrderBy:
    path: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = field(default_factory=tuple)
    order_by: OrderBy | None = None
    limit: int | None = None
    offset: int = 0
    include_deleted: bool = False

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> Query:
        """From URL parameters: filter_path, filter_op, filter_value, sort, dir, limit, offset.

        Numbers that aren't numbers are errors here. Only ``desc`` and ``DESC`` sort downward.
        """
        filters: tuple[Filter, ...] = ()
        if "filter_path" in params and "filter_op" in params and "filter_value" in params:
            filters = (Filter(params["filter_op"], params["filter_path"], jsonexpr.literal(params["filter_value"])),)

        def number(name: str) -> int | None:
            if (text := params.get(name)) is None:
                return None
            if not text.isascii() or not text.isdigit():
                raise InvalidArgument(f"{name} is not a number: {text}")
            return int(text)

        order = OrderBy(params["sort"], params.get("dir") in ("desc", "DESC")) if "sort" in params else None
        return cls(filters, order, number("limit"), number("offset") or 0)

    def matching(self, records: DataFrame) -> DataFrame:
        """Visible records that all filters hold for. A deleted record has no body, so only ``ne`` can."""
        if not self.include_deleted:
            records = records.where(~F.col("deleted"))
        body = F.when(F.col("deleted"), F.lit("null")).otherwise(F.col("body"))
        return records.where(reduce(Column.__and__, [f.column(body) for f in self.filters])) if self.filters else records

    def run(self, records: DataFrame) -> DataFrame:
        """Filter, sort (ties by ascending record_id either way), offset, limit."""
        body = F.when(F.col("deleted"), F.lit("null")).otherwise(F.col("body"))
        keys = jsonexpr.sort_keys(body, self.order_by.path, self.order_by.descending) if self.order_by else []
        out = self.matching(records).orderBy(*keys, "record_id")
        if self.offset:
            out = out.offset(self.offset)
        return out if self.limit is None else out.limit(self.limit)
