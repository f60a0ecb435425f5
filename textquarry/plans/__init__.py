"""Named queries: each pairs a DataFrame builder with the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ["quality_plans", "relational_plans", "analytics_plans", "document_plans", "lifecycle_plans", "source_plans", "search_plans"]


@dataclass(frozen=True)
class Plan:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class PlanSet(dict):
    """Collects plans by decorator: ``@plans.add("name", sql)``."""

    def add(self, name: str, sql: str | None = None, text: tuple[str, ...] = ()):
        """``text``: whole-number columns with nulls, which are compared as text."""

        def put(build):
            if text and sql:
                shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
                self[name] = Plan(lambda spark, d: build(spark, d).withColumns({c: F.col(c).cast("string") for c in text}), f"SELECT * REPLACE ({shown}) FROM ({sql})")
            else:
                self[name] = Plan(build, sql)
            return build

        return put


def all_plans() -> dict[str, Plan]:
    out: dict[str, Plan] = {}
    for module in MODULES:
        out |= importlib.import_module(f"textquarry.plans.{module}").plans
    return out
