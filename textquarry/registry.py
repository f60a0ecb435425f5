"""Every query of the library outside the training-data subpackage, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.plans import all_plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan.build for name, plan in all_plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: plan.sql for name, plan in all_plans().items() if plan.sql}
