"""Session settings and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that results or recovery depend on; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lorewright", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` wins over them."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver found it.

    Needed where the package is run from its folder; on a cluster it is installed or sent along.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


#: Bytes of rows that go to a Python worker at once, so that its memory does not grow with the length of texts.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """A session's batches for Python hold at most ``BATCH_BYTES``; a lower limit of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. The path stays a URI that only Spark opens."""
    let_workers_import(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
