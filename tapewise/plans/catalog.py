"""Registered queries: one per operator, over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.functions.exprs import session_of
from tapewise.plans.inputs import Inputs, inputs
from tapewise.plans.oracles import statement
from tapewise.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, instead: dict[str, str] | None = None):
    """Register ``f(inputs) -> DataFrame`` with the SQL that must agree with it; ``instead`` replaces subqueries."""
    def add(f: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return f(inputs(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = statement(sql, instead)
        return f
    return add


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Comparable output: rounded doubles, long integers, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), special.get(f.name, digits))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DateType,)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = session_of(c).cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def load() -> None:
    from tapewise.plans import queries_decide, queries_panel, queries_research, queries_signal  # noqa: F401
