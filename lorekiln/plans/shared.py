"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share.

    Only in local mode, where that setting may be absent (tests), is a temporary folder made, and set;
    on a cluster a missing setting is an error, since executors can't read each other's folders.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lorekiln-")
        sc.setCheckpointDir(base)
    return f"{str(base).rstrip('/')}/lorekiln/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def release(*written: DataFrame) -> None:
    """Remove the files behind frames of ``materialize`` that no later plan reads."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to).getParent()
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
