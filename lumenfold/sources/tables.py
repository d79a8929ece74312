"""The tables of a directory, and the guard on what may be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class ProtectedInput(ValueError):
    """A path that this run must not read."""


def guard(path: str, denied: tuple[str, ...] = ()) -> str:
    """path, unless it is or lies below a denied one; compared after '.' and '..' are resolved."""
    import posixpath

    plain = posixpath.normpath(path)
    for d in map(posixpath.normpath, denied):
        if plain == d or plain.startswith(d.rstrip("/") + "/"):
            raise ProtectedInput(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str, denied: tuple[str, ...] = ()) -> DataFrame:
    if name not in NAMES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(guard(f"{sf_dir}/{name}.parquet", denied))
