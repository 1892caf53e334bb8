"""Where state is written: the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a master in one process, as in tests, may leave it unset (``/tmp/checkpoints``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut, so state grows no plan from batch to batch."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
