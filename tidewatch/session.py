"""Session helpers: tables of a data folder and the shared folder for checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as the session names it. Without one only a local session goes on, in its warehouse folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that neither a lost executor nor a second use computes it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_of(df: DataFrame) -> int:
    """The partitions of a plain scan; 0 for other plans, as to ask them would run them."""
    q = df._jdf.queryExecution()
    return 0 if q.executedPlan().nodeName() == "AdaptiveSparkPlan" else q.toRdd().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly steps on small inputs; larger inputs are not shuffled.

    Only plain scans are looked at: a plan with exchanges is partitioned by them, and to ask it would run it.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, partitions_of(df)
    return df if parts == 0 or parts >= cores else df.repartition(cores)
