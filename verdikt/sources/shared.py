"""Tables that several branches of a plan read: written once in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


GROUP_BYTES = 4 << 20


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own in local mode where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="verdikt-shared-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that what follows neither computes it again nor depends on its lineage. Row
    groups are small, so that several tasks can read what one has written."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
