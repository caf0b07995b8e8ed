"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset and Spark runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = at.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plainweave-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it: cuts the lineage and survives lost executors."""
    path = f"{workspace(df.sparkSession)}/plainweave-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` has made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
