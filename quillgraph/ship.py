"""Readies a session: the package on the executors, and Arrow batches that whole texts fit in."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Rows and bytes of an Arrow batch, where the session has Spark's own defaults: texts, and groups of texts, are long.
BATCH_ROWS = "2000"
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package once a context, unless the workers' PYTHONPATH already names its folder."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(sc, "_quillgraph", False):
        folder = tempfile.mkdtemp(prefix="quillgraph-ship-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "quillgraph"), "zip", ROOT, "quillgraph"))
        sc._quillgraph = True
    return spark
