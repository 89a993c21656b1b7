"""Adapter projection: bindings of canonical fields to paths or templates of raw rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Binding:
    """One target from a path (column, or column.$.json.path into a JSON text) or a template with {column} holes."""

    target: str
    path: str | None = None
    template: str | None = None
    required: bool = False

    def column(self) -> Column:
        if self.template is not None:
            parts = re.split(r"\{(\w+)\}", self.template)
            return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
        name, _, inner = self.path.partition(".$.")
        return F.try_variant_get(F.try_parse_json(F.col(name)), f"$.{inner}", "string") if inner else F.col(name)


def project(rows: DataFrame, key: str, bindings: list[Binding]) -> DataFrame:
    """key, the targets and whether the row abstains, as a required target is missing."""
    out = rows.select(key, *[b.column().alias(b.target) for b in bindings])
    missing = [F.col(b.target).isNull() for b in bindings if b.required]
    lost = missing[0] if missing else F.lit(False)
    for m in missing[1:]:
        lost = lost | m
    return out.withColumn("abstains", lost)
