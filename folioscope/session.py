"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join followed by an aggregation on the same key would otherwise keep a
    # hot partition whole to save one exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans rely on; partition counts stay the cluster's."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = (context.getConf().get("spark.checkpoint.dir")
             or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir())
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, and go on from what was written.

    The files outlive the executors that wrote them, so a lost executor costs a
    re-read and not the lineage. Later steps read only the columns they need, and
    the planner knows the size of the table. Most of it is identifiers in hexadecimal, which
    zstd halves and Parquet's default leaves as they are.
    """
    spark = df.sparkSession
    path = f"{_settled_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _settled_folder(spark: SparkSession) -> str:
    """One folder per application, so a finished one can be released as a whole."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/settled/{application}"


def release(spark: SparkSession) -> None:
    """Remove what this application settled. Call it after the last result is written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_settled_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
