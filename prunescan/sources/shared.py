"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset a local session makes a folder; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="prunescan-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder
