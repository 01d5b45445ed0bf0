"""Typed reads from semi-structured payloads: a value of another type reads as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aislegraph.functions.text import full_trim


def parse(col: Column) -> Column:
    """Payload text to a variant, null when it is not valid JSON."""
    return F.try_parse_json(col)


def kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def filled_at(v: Column, path: str) -> Column:
    """A text that is not empty."""
    return F.nullif(text_at(v, path), F.lit(""))


def number_at(v: Column, path: str) -> Column:
    return F.when(kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))


def list_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def is_true(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean") & (kind(v, path) == "BOOLEAN"), F.lit(False))


def first_text(v: Column, *paths: str) -> Column:
    """First text that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(full_trim(text_at(v, p)), F.lit("")) for p in paths])
