"""Names of the registered queries, their functions and their DuckDB SQL."""

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notelake.sources.tables import table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The logical tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(tables)`` under its name, with its DuckDB twin if it has one."""

    def keep(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = with_tables(sql)
        return f

    return keep


for _module in ("scans", "functions", "joins", "journal", "retrieval", "policy", "lifecycle", "streams", "hooks"):
    if importlib.util.find_spec(f"notelake.plans.{_module}"):
        importlib.import_module(f"notelake.plans.{_module}")
