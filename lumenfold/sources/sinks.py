"""Writers: reproducible JSON lines, reports that are never overwritten, partitioned rows, redaction, manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash60


def sorted_jsonl(rows: DataFrame, path: str, key: list[str], files: int | None = None) -> DataFrame:
    """JSON lines sorted by key across files (range partitioned, so that large tables need no single task). Returns a one-row manifest: rows and an
    order-free digest of what was written."""
    dealt = rows.repartitionByRange(files, *key) if files else rows.repartitionByRange(*key)
    dealt.sortWithinPartitions(*key).write.json(path)
    line = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(hash60(line).cast("decimal(38,0)")).cast("string").alias("digest"))


def exclusive_report(rows: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    rows.write.mode("errorifexists").json(path)


def by_split_and_slice(rows: DataFrame, path: str, key: str, split: str = "split", part: str = "slice") -> DataFrame:
    """Rows to path/rows and what else is known of them (columns that begin with '_', without the underscore, beside the key) to path/meta, both partitioned by
    split and slice; never over what is there. Returns the counts (split, slice, rows) of what was written."""
    plain = [c for c in rows.columns if not c.startswith("_")]
    sidecar = [F.col(c).alias(c.lstrip("_")) for c in rows.columns if c.startswith("_")]
    rows.select(*plain).write.mode("errorifexists").partitionBy(split, part).parquet(f"{path}/rows")
    rows.select(key, split, part, *sidecar).write.mode("errorifexists").partitionBy(split, part).parquet(f"{path}/meta")
    return rows.groupBy(split, part).agg(F.count(F.lit(1)).alias("rows"))


def csv_table(tables: list[DataFrame], path: str, order: list[str]) -> list[str]:
    """Tables of one report as one CSV under one header: the sorted union of their columns, empty where a table lacks one; sorted by order. Returns the header."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    header = sorted(out.columns)
    out.select(*header).repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", "true").csv(path)
    return header


def allowed(rows: DataFrame, columns: list[str], longest: int = 256) -> DataFrame:
    """Only the allowed columns; strings bounded, arrays cut at 32 elements: content that isn't listed can't leave."""
    out = []
    for c in columns:
        kind = rows.schema[c].dataType.typeName()
        value = F.substring(c, 1, longest) if kind == "string" else F.slice(c, 1, 32) if kind == "array" else F.col(c)
        out.append(value.alias(c))
    return rows.select(*out)


def without_private(rows: DataFrame) -> DataFrame:
    """Columns whose names begin with '_' are provenance and stay behind."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def without_keys(rows: DataFrame, forbidden: str) -> DataFrame:
    """Drops fields whose name matches the pattern, at any depth of structs."""
    from pyspark.sql import types as T

    bad = re.compile(forbidden)

    def rebuild(column, kind):
        if isinstance(kind, T.StructType):
            kept = [rebuild(column[f.name], f.dataType).alias(f.name) for f in kind if not bad.search(f.name)]
            return F.when(column.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(column, lambda x: rebuild(x, kind.elementType))
        return column

    return rows.select(*[rebuild(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema if not bad.search(f.name)])


def manifest(spark, path: str) -> DataFrame:
    """(name, sha256, bytes) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.lit(path.rstrip("/").split(":")[-1] + "/")
    return files.select(F.element_at(F.split("path", base), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))
