"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proselake.plans import catalogue, evaluation, measures, samples
from proselake.sources.readers import tables

CATALOGUE = catalogue.CATALOGUE | measures.MEASURES | evaluation.EVALUATION


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, folder, f=f, names=names: f(*[tables(spark, folder, t) for t in names]) for name, (f, names, _) in CATALOGUE.items()} | samples.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in CATALOGUE.items()} | samples.oracle_sql()
