"""Registry of queries with their SQL: one list of output columns serves both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finpanel.plans.adapters import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def columns(spec: str) -> list[tuple[str, str]]:
    """``a b# c~6``: names; # casts to long, ~6 rounds a computed double to six decimals."""
    return [(part.rstrip("#").partition("~")[0], "#" if part[-1] == "#" else part.partition("~")[2]) for part in spec.split()]


def _spark(name: str, how: str):
    return F.col(name).cast("long").alias(name) if how == "#" else F.round(F.col(name), int(how)).alias(name) if how else F.col(name)


def _duckdb(name: str, how: str) -> str:
    return f"CAST({name} AS BIGINT) AS {name}" if how == "#" else f"round({name}, {how}) AS {name}" if how else name


def query(name: str, spec: str, needs: str = "", sql: str | None = None, **extra: str):
    """Registers a function of ``Tables``; ``sql`` selects from the domain tables named in ``needs`` and from ``extra`` tables."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir)).select(*[_spark(c, how) for c, how in columns(spec)])

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            shown = ", ".join(_duckdb(c, how) for c, how in columns(spec))
            ORACLES[name] = f"{ctes(*needs.split(), extra=extra)}SELECT {shown} FROM ({sql}) AS result"
        return f

    return register
