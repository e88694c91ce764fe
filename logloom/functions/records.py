"""Strict reads from VARIANT: a value of another kind is null, never converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def strict_text(v: Column, path: str) -> Column:
    return F.when(kind_of(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def strict_long(v: Column, path: str) -> Column:
    """A JSON integer; true, 1.5 and '1' are null."""
    return F.when(kind_of(v, path) == "BIGINT", F.try_variant_get(v, path, "long"))


def strict_bool(v: Column, path: str) -> Column:
    return F.when(kind_of(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path).startswith("OBJECT"), F.lit(False))


def variant_array(v: Column, path: str) -> Column:
    """The elements of a JSON array; empty for anything else."""
    found = F.when(kind_of(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))
    return F.coalesce(found, F.array().cast("array<variant>"))


def seconds(v: Column, path: str) -> Column:
    """{secs, nanos} as seconds."""
    return F.when(strict_long(v, f"{path}.secs").isNotNull(), strict_long(v, f"{path}.secs") + F.coalesce(strict_long(v, f"{path}.nanos"), F.lit(0)) / 1e9)
