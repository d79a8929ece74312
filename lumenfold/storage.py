"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary folder, but only on a local master: on a cluster its
    machines would each write to their own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lumenfold-"))
        path = _OWN[0]
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed at exit if not before."""
    path = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenfold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_lumenfold_path", None)
    if path in _WRITTEN:
        _remove(df.sparkSession, path)
        _WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that nothing refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _WRITTEN if spark else ():
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return
