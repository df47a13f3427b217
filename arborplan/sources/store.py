"""Tables that a step stores once, in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a driver that runs its tasks itself may go without it and gets a folder of its own."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there is None and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if sc.getCheckpointDir() is None:
        there = there or "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(there)
    return there


def stored(df: DataFrame) -> DataFrame:
    """df, computed once; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone already
            sc = spark.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
