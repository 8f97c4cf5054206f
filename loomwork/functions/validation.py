"""Validators as columns: each gives what is wrong with a value, null if nothing is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension, normalize_path

# fixed values: extensions of sources whose constructs can be found again by a marker, and of declaration files
DYNAMIC = ("rs", "js", "jsx", "mjs", "cjs", "py", "sh", "bash", "zsh", "lean", "tla")
DECLARATIONS = ("yaml", "yml", "json", "toml")


def path_fault(path: Column) -> Column:
    """A location's path is relative to the root and doesn't leave it."""
    plain = normalize_path(path)
    bad = (plain == "") | plain.startswith("/") | F.array_contains(F.split(plain, "/"), "..")
    return F.when(path.isNull(), "a path is missing").when(bad, "a path must be relative and stay inside")


def range_fault(start: Column, end: Column) -> Column:
    """Lines count from 1 and don't run backwards; either may be missing."""
    return F.when(F.coalesce(start == 0, F.lit(False)) | F.coalesce(end == 0, F.lit(False)) | F.coalesce(end < start, F.lit(False)), "an invalid line range")


def location_fault(path: Column, start: Column, end: Column, symbol: Column, watch: Column) -> Column:
    """Of a location as a user gives it: nothing else is allowed without a path."""
    other = start.isNotNull() | end.isNotNull() | symbol.isNotNull() | watch.isNotNull()
    return F.when(path.isNull(), F.when(other, "a path is required")).otherwise(F.coalesce(path_fault(path), F.when(F.btrim(path) == "", "a path is missing"), range_fault(start, end)))


def id_fault(identifier: Column) -> Column:
    bad = F.coalesce(F.btrim(identifier) == "", F.lit(True)) | identifier.rlike(r"\s")
    return F.when(bad, "an id can't be empty or contain white space")


def review_id_fault(identifier: Column) -> Column:
    return F.when(~F.coalesce(identifier.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False)), "a review's id has letters, digits, '.', '-' and '_' only")


def is_dynamic(path: Column) -> Column:
    """Whether the extents of a source's constructs can be found by markers."""
    return F.coalesce(extension(path).isin(*DYNAMIC), F.lit(False))


def is_declarations(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*DECLARATIONS), F.lit(False))


def hit_reason(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("match "), path, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
