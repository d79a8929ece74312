"""Connected components, families and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


#: A round's table is written by tasks of about so many rows: few edges make few files.
EDGES_A_FILE = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every end of an edge; root is the smallest node reachable.

    Alternating large-star and small-star steps on the edge table. Each step takes a node's smallest
    neighbour by a partially aggregated minimum and joins it back, so a hub's edges are never in one task
    by necessity (the joins can be split when skewed). Rows never outgrow twice the edges. Edges with a null
    end and loops only name their node. Any orderable key type. An empty table gives an empty table.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    now = materialize(_ordered(pairs))
    state = _state(now)
    files = 1 + 2 * state[0] // EDGES_A_FILE
    for _ in range(max_rounds):
        if not state[0]:
            break
        nxt = materialize(_small_star(_large_star(now)).coalesce(files))
        after = _state(nxt)
        discard(now)
        now = nxt
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each edge once, from its larger end u to its smaller end v."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges run from larger u to smaller v: all of u's smaller neighbours, and u, hang on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def key_edges(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """(src, dst): every row to the least row that shares a key's value. Null keys link nothing. The least rows are partial minima, so a key that a third of all
    rows have is no task's burden."""
    parts = []
    for k in keys:
        own = rows.select(F.col(row_id).alias("src"), F.col(k).alias("_k")).where("_k is not null")
        least = own.groupBy("_k").agg(F.min("src").alias("dst"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k", "dst")
        parts.append(own.join(least, "_k").select("src", "dst").where("src <> dst"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def multi_key_components(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """(row_id, component): the smallest row id among rows connected through any of the keys. A row without keys is alone."""
    found = connected_components(key_edges(rows, row_id, keys)).select(F.col("node").alias(row_id), "root")
    return rows.select(row_id).join(found, row_id, "left").select(row_id, F.coalesce("root", row_id).alias("component"))


def families(rows: DataFrame, family: str, lists: list[str]) -> DataFrame:
    """A row a family: its size and, for each of lists, the sorted distinct values."""
    return rows.groupBy(family).agg(F.count(F.lit(1)).alias("members"), *[F.array_sort(F.collect_set(c)).alias(c) for c in lists])


def declared_merges(merges: DataFrame, nodes: DataFrame, strata: str) -> DataFrame:
    """Checks declared merges (left_id, right_id) against nodes (id, strata): problem is unknown_id, repeated, spans_strata or null."""
    from pyspark.sql import Window

    a = nodes.select(F.col("id").alias("left_id"), F.col(strata).alias("_a"))
    b = nodes.select(F.col("id").alias("right_id"), F.col(strata).alias("_b"))
    again = Window.partitionBy(F.least("left_id", "right_id"), F.greatest("left_id", "right_id"))
    joined = merges.withColumn("_n", F.count(F.lit(1)).over(again)).join(a, "left_id", "left").join(b, "right_id", "left")
    problem = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown_id").when(F.col("_n") > 1, "repeated").when(F.col("_a") != F.col("_b"), "spans_strata")
    return joined.select("left_id", "right_id", problem.alias("problem"))
