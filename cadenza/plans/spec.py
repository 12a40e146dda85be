"""A registered query: what it runs, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.views import with_views

DIGITS = 6


@dataclass(frozen=True)
class Query:
    """Both sides give the columns ``ids`` as they are and ``numbers`` rounded."""

    make: Callable[[SparkSession, str], DataFrame]
    ids: tuple[str, ...]
    numbers: tuple[str, ...] = ()
    sql: str | None = None
    views: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = self.make(spark, sf_dir)
        return rows.select(*[F.col(c) for c in self.ids], *[(F.round(F.col(c).cast("double"), DIGITS) + 0.0).alias(c) for c in self.numbers])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        columns = [f'"{c}"' for c in self.ids] + [f'round("{c}"::DOUBLE, {DIGITS}) + 0.0 AS "{c}"' for c in self.numbers]
        body, views = self.sql.strip(), self.views
        if body[:5].upper() == "WITH ":
            # The last query of the body is the one outside all brackets.
            depth, cut = 0, 0
            for i in range(len(body)):
                depth += {"(": 1, ")": -1}.get(body[i], 0)
                if depth == 0 and body[i : i + 7].upper() == "SELECT " or depth == 0 and body[i : i + 5].upper() == "FROM (" and not cut:
                    cut = i
                    break
            return with_views(f"{body[:cut].rstrip()}, _q AS ({body[cut:]})\nSELECT {', '.join(columns)} FROM _q", *views)
        return with_views(f"WITH _q AS ({body})\nSELECT {', '.join(columns)} FROM _q", *views)


def q(make, ids: str, numbers: str = "", sql: str | None = None, views: str = "") -> Query:
    return Query(make, tuple(ids.split()), tuple(numbers.split()), sql, tuple(views.split()))
