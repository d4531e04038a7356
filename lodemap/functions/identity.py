"""Identifiers of graph nodes: stable, scoped by repository, never changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_id(repo: Column, path: Column) -> Column:
    return F.concat_ws(":", repo, path)


def member_id(file: Column, name: Column) -> Column:
    """A class or function of a file."""
    return F.concat_ws("::", file, name)


def route_id(repo: Column, method: Column, path: Column) -> Column:
    return F.concat_ws(":", repo, F.upper(method), path)


def call_id(file: Column, line: Column, target_type: Column, target_method: Column) -> Column:
    return F.concat(file, F.lit("::call:"), line.cast("string"), F.lit(":"), target_type, F.lit("."), target_method)


def start_id(file: Column, key: Column, line: Column) -> Column:
    return F.concat(file, F.lit("::process-start:"), key, F.lit(":"), line.cast("string"))


def alias(name: Column) -> Column:
    """The name by which containers know an object of a class: its first letter in lower case."""
    return F.concat(F.lower(F.left(name, F.lit(1))), F.substring(name, 2, 1 << 30))
