"""Folders that the driver and all tasks share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder, to be made by whoever writes there, below the checkpoint folder; it goes when the driver ends.

    A local folder only where none is configured and there are no other machines.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickspark-")
        spark.sparkContext.setCheckpointDir(root)
    out = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return out
