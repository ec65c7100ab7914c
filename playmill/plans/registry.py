"""Queries and their SQL oracles, registered by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playmill.plans.bindings import relation, with_relations
from playmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *inputs: str):
    """Register a function of the named relations or tables (``t:name``) as a query, with its oracle if SQL has one."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, i[2:]) if i.startswith("t:") else relation(spark, sf_dir, i) for i in inputs])

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_relations(sql)
        return f

    return wrap


def job(name: str, sql: str | None):
    """Register a function of the session and the folder of the tables, for queries that write and read files."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_relations(sql)
        return f

    return wrap


from playmill.plans import context_plans, features, files, io, quality, records, results, scalars, sequences, stores, streams, training_plans  # noqa: E402, F401
