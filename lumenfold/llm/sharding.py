"""Sharding by proportional stratified interleaving (native: DataFrame functions only).

Rows are shuffled by a seeded hash within each source, ranked, and sorted by fractional rank
(rank - 1/2) / rows of the source. Every stretch of that order holds the sources in the corpus's mixture, so
contiguous cuts are shards that match it. Ranks over all rows come from prefix sums over about sqrt(n)
hash buckets of about sqrt(n) rows: no window holds a whole source or the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

HASH_BITS = 60


def shuffle_hash(key: Column, seed: int) -> Column:
    """The first 60 bits of md5('seed:key'), as a long: the seeded shuffle's order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, HASH_BITS // 4), 16, 10).cast("long")


def running(df: DataFrame, bucket: str, strata: list[str]) -> DataFrame:
    """(strata, bucket, before, total): rows of the stratum in earlier buckets, and in all."""
    counts = df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata)
    upto = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*strata, bucket, (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_total"))


def interleave(docs: DataFrame, *, shards: int, seed: int = 42, source: str = "source", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, source, fraction, shard, slot for every row.

    Shards differ by one row at most, whatever the sources' sizes. A null source is a stratum of its own; rows without an id are
    shuffled by their text's crc32 and size, so that they are no one bucket; a null text has size `overhead` and the crc32 of the empty text. Rows with equal ids,
    sizes and texts are interchangeable; other ties fall to id, crc and size. An empty table gives none.
    """
    n = docs.count()
    buckets = max(1, math.isqrt(n))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("|", F.lit("null"), crc.cast("string"), size.cast("string")))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.col(source).isNull().alias("_null"),
        size.alias("size"),
        crc.alias("text_crc32"),
        shuffle_hash(key, seed).alias("_h"),
    ).withColumn("_b", _bucket(F.col("_h"), buckets))
    strata = ["_source", "_null"]
    light = docs.select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.col(source).isNull().alias("_null"),
        _bucket(shuffle_hash(key, seed), buckets).alias("_b"),
    )
    order = ["_h", "doc_id", "text_crc32", "size"]
    within = Window.partitionBy(*strata, "_b").orderBy(*order)
    ranked = (
        rows.join(running(light, "_b", strata), [*strata, "_b"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(within))
        .withColumn("fraction", (2 * F.col("_rank") - 1) / (2 * F.col("_total")))
        .withColumn("_f", F.floor(F.col("fraction") * buckets))
        .drop("_before", "_total", "_b", "_rank")
    )
    ranked = materialize(ranked)
    along = Window.partitionBy("_f").orderBy("fraction", *order, *strata)
    return (
        ranked.join(running(ranked, "_f", []), "_f")
        .withColumn("_at", F.col("_before") + F.row_number().over(along) - 1)
        .withColumn("shard", F.expr(f"cast(_at * {shards} div _total as int)"))
        .withColumn("slot", F.expr(f"_at - cast((cast(shard as bigint) * _total + {shards - 1}) div {shards} as bigint)"))
        .select("doc_id", "size", "text_crc32", F.when(~F.col("_null"), F.col("_source")).alias("source"), "fraction", "shard", "slot")
    )


def _bucket(h: Column, buckets: int) -> Column:
    return F.shiftright(F.shiftright(h, HASH_BITS - 30) * F.lit(buckets), 30)


def op2(spark, sf_dir):
    from .common import table

    rows = interleave(table(spark, sf_dir, "documents"), shards=40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def oracle(shards: int = 40, seed: int = 42) -> str:
    """The same in DuckDB SQL; the crc32 is folded over the text's bits."""
    return f"""
WITH b AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
  list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || x)::BIGINT >> k) & 1)))) AS bits FROM documents),
x AS (SELECT doc_id, source, size, xor(list_reduce(bits, lambda a, x: xor(a >> 1, 3988292384 * xor(a & 1, x))), 4294967295)::BIGINT AS crc FROM b),
c AS (SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null|' || crc || '|' || size)), 1, 15))::BIGINT AS h FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc, size) AS k, count(*) OVER (PARTITION BY source) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * k - 1)::DOUBLE / (2 * n), h, doc_id, crc, size, source) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, pos * {shards} // total AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INT AS shard, (pos - (shard * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM s"""
