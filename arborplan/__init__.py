"""A directory-plan engine on Spark, and operators for training data."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at once; documents are long, and each executor's workers hold a batch or two.
ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and keeps their batches small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if int(spark.conf.get(_BATCH)) > ROWS:
        spark.conf.set(_BATCH, str(ROWS))
    return spark
