"""Set operations and keyed upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def bind_rows(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def upsert_by_key(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``target`` whose keys ``new`` doesn't have, and all of ``new``."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_by_subject(target: DataFrame, new: DataFrame, subject: str = "subject") -> DataFrame:
    """Replaces all rows of the subjects of ``new``."""
    return upsert_by_key(target, new, [subject])


def skip_completed(work: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(manifest.select(*keys).distinct(), keys, "left_anti")
