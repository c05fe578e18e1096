"""Helpers shared by the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Lets Python workers that start from now on import this package from where the driver
    has it (elsewhere, ship it with --py-files)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where
    the session has none and runs in one JVM (tests, local mode) is a folder made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docweave-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def skew_join(big: DataFrame, small: DataFrame, on: str, weight: str, shares: int = 4096, salts: int = 256) -> DataFrame:
    """Inner join on a key that may hold any part of big's rows. small is a table that has been
    written, with one row a key and weight, the rows of big with that key (or more). Keys of more
    than 1/shares of all rows, at most shares, are dealt to salts tasks by a hash of big's rows."""
    total = small.agg(F.sum(weight)).first()[0] or 0
    frequent = F.col(weight) * shares > total
    marked = big.join(F.broadcast(small.where(frequent & (F.col(weight) > 1000)).select(on, F.lit(True).alias("dw_often"))), on, "left")
    salt = F.when(F.col("dw_often"), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    dealt = F.when(frequent & (F.col(weight) > 1000), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("dw_salt", salt).drop("dw_often").join(small.withColumn("dw_salt", F.explode(dealt)), [on, "dw_salt"]).drop("dw_salt")


_written: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet below the shared folder and read it back.

    Survives lost executors, unlike a local checkpoint. The files go with forget(), or when
    the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point up to which tables have been written, for forget()."""
    return len(_written)


def forget(since: int, keep: DataFrame) -> None:
    """Delete the tables written since a mark, but for those that keep is read from."""
    used = " ".join(keep.inputFiles())
    stay = []
    for spark, path in _written[since:]:
        folder = path.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[1] in used:
            stay.append((spark, path))
        else:
            _delete(spark, folder)
    _written[since:] = stay


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path.rsplit("/", 1)[0])
        except Exception:  # the session may be gone by now
            return
