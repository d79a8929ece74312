"""Queries by name, each with the SQL that DuckDB runs on the same tables where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(t) -> DataFrame, where t(table name) reads a table."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        QUERIES[name].__doc__ = f.__doc__
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def L(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def R(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


# Fragments of the SQL side.
def h60(x: str) -> str:
    return f"(('0x' || substr(sha256({x}), 1, 15))::BIGINT)"


def bucket_sql(x: str) -> str:
    return f"((('0x' || substr(sha256({x}), 1, 16))::UBIGINT % 10000)::BIGINT)"


def split_sql(x: str, salt: str) -> str:
    b = bucket_sql(f"'{salt}|' || {x}")
    return f"(CASE WHEN {b} < 1000 THEN 'test' WHEN {b} < 2000 THEN 'val' ELSE 'train' END)"


PLAIN = r"trim(regexp_replace(lower(text), '[ \t\r\n\f\x0B]+', ' ', 'g'))"
KEYED = f"(SELECT *, {PLAIN} AS key FROM documents)"
LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
