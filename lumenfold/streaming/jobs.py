"""Structured Streaming jobs, and the batch twins of the stateful ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def events_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """The events table as a stream; ts becomes a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is available now and returns the sink's rows. With append the sink is a Parquet table of the shared
    folder (exactly once by its commit log); complete and update keep the last result in memory: use them for small aggregates only."""
    import uuid

    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", where + "/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", where + "/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(where + "/out")
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    writer.format("memory").queryName(table).start().awaitTermination()
    return spark.table(table)


def type_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def closed_windows(events: DataFrame, size: str = "6 hours") -> DataFrame:
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def one_outcome(events: DataFrame, key: str) -> DataFrame:
    """One record a key within the watermark: exactly-one-outcome."""
    return events.dropDuplicatesWithinWatermark([key])


def rotating_sink(stream: DataFrame, path: str, checkpoint: str, items: int, octets: int, order: list[str], keep: int | None = None):
    """JSON lines by micro-batch into path/batch=<number>: by order, the rows that fit in `items` and `octets` (of their JSON); what is over is counted by
    outcome, never waited for. Counts go to path/_outcomes with the batch's number, so that a batch that is run again writes the same once more. With
    keep only the last `keep` batches' files stay. Returns the query."""
    from pyspark.sql import Window

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        line = F.to_json(F.struct(*batch.columns))
        upto = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # one micro-batch, bounded by its trigger
        sized = batch.withColumn("_n", F.row_number().over(upto)).withColumn("_b", F.sum(F.octet_length(line) + 1).over(upto))
        named = sized.withColumn("_outcome", F.when(F.col("_n") > items, "DROPPED_ITEMS").when(F.col("_b") > octets, "DROPPED_BYTES").otherwise("WRITTEN")).persist()
        named.where("_outcome = 'WRITTEN'").drop("_n", "_b", "_outcome").write.mode("overwrite").json(f"{path}/batch={number:08d}")
        named.groupBy(F.col("_outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/_outcomes/batch={number:08d}")
        named.unpersist()
        if keep is not None and number >= keep:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - keep:08d}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(outcome, n) of all batches of a rotating sink."""
    return spark.read.schema("outcome string, n long").json(f"{path}/_outcomes/*").groupBy("outcome").agg(F.sum("n").alias("n"))


def switched(stream: DataFrame, flag: str, path: str, checkpoint: str, on: str, off: str):
    """Each micro-batch with the mode that the presence of the file `flag` says when the batch begins: on if it is there, else off. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(flag)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        batch.withColumn("mode", F.lit(on if there else off)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spend(times: list[float], rate_per_s: float, burst: float, tokens: float | None = None, last: float | None = None):
    """Whether each request of a sorted run gets a token; and the state after it."""
    out = []
    tokens = burst if tokens is None else tokens
    for at in times:
        if last is not None:
            tokens = min(burst, tokens + max(0.0, at - last) * rate_per_s)
        last = at
        granted = tokens >= 1.0
        tokens -= granted
        out.append(granted)
    return out, tokens, last


def token_bucket_batch(events: DataFrame, rate_per_s: float, burst: float) -> DataFrame:
    """event_id, user_id, granted: a bucket a user, requests in order of time. A user's rows are one group: the state is sequential by definition."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "event_id"])
        granted, _, _ = spend(rows["at"].tolist(), rate_per_s, burst)
        return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "granted": granted})

    rows = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("user_id").applyInPandas(run, "event_id long, user_id long, granted boolean")


def token_bucket_stream(events: DataFrame, rate_per_s: float, burst: float) -> DataFrame:
    """The same with state kept between micro-batches."""

    def run(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        tokens, last = state.get if state.exists else (None, None)
        granted, tokens, last = spend(rows["at"].tolist(), rate_per_s, burst, tokens, last)
        state.update((tokens, last))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "granted": granted})

    rows = events.select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, granted boolean", "tokens double, last double", "append", "NoTimeout")


def admit(times: list[float], slots: int, waiting: int, service_s: float) -> list[str]:
    """served at once, queued, or refused: `slots` servers of fixed service time, at most `waiting` in line."""
    import heapq

    busy: list[float] = []
    out = []
    for at in times:
        while busy and busy[0] <= at:
            heapq.heappop(busy)
        if len(busy) < slots:
            heapq.heappush(busy, at + service_s)
            out.append("served")
        elif len(busy) < slots + waiting:
            free = sorted(busy)[len(busy) - slots]
            heapq.heappush(busy, free + service_s)
            out.append("queued")
        else:
            out.append("refused")
    return out


def admission_batch(events: DataFrame, slots: int, waiting: int, service_s: float) -> DataFrame:
    """event_id, user_id, outcome: a gate a user."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "event_id"])
        return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "outcome": admit(rows["at"].tolist(), slots, waiting, service_s)})

    rows = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("user_id").applyInPandas(run, "event_id long, user_id long, outcome string")


def log_tail(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((file, at, line), (file, offset)): the complete lines of growing files beyond each file's offset (0 where offsets has none), `at` their place in
    bytes, and the offsets after them. A last line without its LF waits for the next call. A file that has become shorter is read anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.length("content").alias("size"))
    known = offsets if offsets is not None else spark.createDataFrame([], "file string, offset long")
    both = files.join(known.select("file", F.col("offset").alias("o")), "file", "left").withColumn("o", F.when(F.col("o") <= F.col("size"), F.col("o")).otherwise(F.lit(0)))
    fresh = F.decode(F.substring("content", (F.col("o") + 1).cast("int"), F.col("size").cast("int")), "ISO-8859-1")  # a character a byte
    whole = both.select("file", "o", F.regexp_extract(fresh, r"(?s)^(.*\n)", 1).alias("w"))
    cut = F.split(F.col("w"), "\n")
    starts = F.aggregate(cut, F.array(F.col("o").cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    rows = whole.where("w <> ''").select("file", F.posexplode(F.slice(cut, F.lit(1), F.size(cut) - 1)).alias("p", "l"), starts.alias("s"))
    lines = rows.select("file", F.get("s", F.col("p")).alias("at"), F.decode(F.encode("l", "ISO-8859-1"), "UTF-8").alias("line"))
    return lines, whole.select("file", (F.col("o") + F.length("w")).cast("long").alias("offset"))


def schedule(spark: SparkSession, rate: float, seconds: float, seed: str) -> DataFrame:
    """Open-loop Poisson arrivals (n, at_s): exponential gaps drawn from hashes, so that a rerun offers the same load. A prefix sum over
    the offers of one load step."""
    from pyspark.sql import Window

    from ..functions.keys import hash60

    n = int(rate * seconds * 2) + 10
    u = (hash60(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))) + F.lit(1)) / F.lit(float(1 << 60))
    gaps = spark.range(n).select(F.col("id").alias("n"), (-F.log(u) / rate).alias("gap"))
    at = F.sum("gap").over(Window.partitionBy().orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return gaps.select("n", at.alias("at_s")).where(F.col("at_s") < seconds)
