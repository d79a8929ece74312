"""What the operators of this package share: reading, bounded samples, memory for words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import discard, materialize, release

__all__ = ["Memo", "connected_components", "discard", "held_out", "materialize", "per_worker", "release", "small_batches", "spare", "table", "training_sample"]


#: A batch of texts: 512 rows, or as many as come to these bytes; a longer text is a batch of its own.
BATCH_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds Arrow batches of this session, for good, by rows and by bytes where its settings allow more: texts can be long, and a Python worker holds a
    batch whole. (Plans read the settings when they run, so they can't be put back here.)"""
    octets = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, number in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows, int), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, octets)):
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def per_worker(shared, make):
    """What make builds from a broadcast dict, built once in each Python worker that reads it."""
    value = shared.value
    if "_made" not in value:
        value["_made"] = make(value)
    return value["_made"]


class Memo:
    """What make(word) gives, remembered for words of up to `longest` characters, in two generations of at most `limit`
    words: when the younger is full it becomes the older, so words in use stay. make never gives None."""

    def __init__(self, make, limit: int = 200_000, longest: int = 80):
        self.make, self.limit, self.longest, self.known, self.older = make, limit, longest, {}, {}

    def __call__(self, words: list[str]) -> list:
        out = list(map(self.known.get, words))
        at = -1
        while True:
            try:
                at = out.index(None, at + 1)
            except ValueError:
                return out
            out[at] = self.one(words[at])

    def one(self, word: str):
        value = self.known.get(word)
        if value is None:
            value = self.older.get(word)
            if value is None:
                value = self.make(word)
            if len(word) <= self.longest:
                if len(self.known) >= self.limit:
                    self.known, self.older = {}, self.known
                self.known[word] = value
        return value


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as the text 'null')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 11) -> list:
    """At most per_class labelled rows of either class, by hash order: [(text, label)].

    Learns only from ids that are not held out. Ids labelled twice count once, with the largest label.
    Null ids, labels and texts teach nothing. The two bounded id lists are picked by top-k, so that
    the text table is scanned once and joined to at most 2 * per_class ids.
    """
    lab = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("_y"))
        .withColumn("_h", F.xxhash64(F.lit(seed), "_id"))
    )
    picked = [lab.where(F.col("_y") == y).orderBy("_h", "_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = (
        docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        .where(F.col("_text").isNotNull())
        .join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
        .groupBy("_id", "_y", "_h")
        .agg(F.min("_text").alias("_text"))
        .collect()
    )
    return [(r["_text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_h"], r["_id"]))]
