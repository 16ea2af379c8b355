"""Written tables in the shared checkpoint folder, used to cut lineage and to reuse a result."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one, which only a local master can share."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    spark.sparkContext.setCheckpointDir(place)
    return place


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: later jobs start from the files, which go when the
    driver ends, or before with dropped()."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, system = _path(spark, where)
    system.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table made by written(), once nothing reads it again."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, system = _path(df.sparkSession, name)
        system.delete(path, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
