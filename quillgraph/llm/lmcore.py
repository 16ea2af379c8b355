"""LmCore.java over DataFrames: compiled once a context by Janino, the compiler of Spark's generated code, and sent to the
executors as a jar. Arrays reach the driver's JVM by a temporary file of the driver, and the executors as broadcasts."""

from __future__ import annotations

import os
import pkgutil
import struct
import tempfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

NAME = "LmCore"
COUNT, FIT, SCORE = range(3)
#: Numbers before the slots, as in the class.
PAD = 24
TYPES = {np.dtype(k): code for k, code in (("u1", b"b"), ("u2", b"h"), ("i4", b"i"), ("u4", b"i"), ("f4", b"f"), ("i8", b"l"), ("u8", b"l"), ("f8", b"d"))}


def _class(spark: SparkSession):
    """The compiled class, on the driver; executors have its jar."""
    sc = spark.sparkContext
    if not hasattr(sc, "_quillgraph_core"):
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data(__package__, f"{NAME}.java").decode())
        made = compiler.getBytecodes()
        path = os.path.join(tempfile.mkdtemp(prefix="quillgraph-core-"), f"{NAME}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name in list(made.keySet()):
                jar.writestr(name.replace(".", "/") + ".class", bytes(made[name]))
        sc._jsc.addJar(path)
        sc._quillgraph_core = compiler.getClassLoader().loadClass(NAME)
    return sc._quillgraph_core


def _method(spark: SparkSession, kind: str, *given):
    """What a constructor ('new') or static method of the class gives."""
    jvm, own = spark.sparkContext._jvm, _class(spark)
    values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(given))
    for i, x in enumerate(given):
        values[i] = x
    if kind == "new":
        return own.getConstructors()[0].newInstance(values)
    return next(m for m in own.getMethods() if m.getName() == kind).invoke(None, values)


def arrays(spark: SparkSession, *given: np.ndarray):
    """Java arrays of the same numbers (bool as byte), in an Object[]."""
    held, path = tempfile.mkstemp(prefix="quillgraph-core-")
    try:
        with os.fdopen(held, "wb") as f:
            for x in given:
                x = x.view(np.uint8) if x.dtype == bool else x
                f.write(TYPES[x.dtype] + struct.pack(">i", x.size))
                f.write(memoryview(np.ascontiguousarray(x, x.dtype.newbyteorder("<"))).cast("B"))
        return _method(spark, "read", path, len(given))
    finally:
        os.unlink(path)


def shared(spark: SparkSession, *given: np.ndarray):
    return spark.sparkContext._jsc.broadcast(arrays(spark, *given))


def mapped(rows: DataFrame, schema: str, mode: int, model, slots, values) -> DataFrame:
    """Rows of that schema from partitions of rows: COUNT and FIT take a binary text, SCORE (doc_id, binary text, held_out)."""
    spark = rows.sparkSession
    core = _method(spark, "new", mode, model, slots, values)
    kind = spark._jsparkSession.parseDataType(spark.createDataFrame([], schema).schema.json())
    return DataFrame(rows._jdf.mapPartitions(core, spark._jvm.org.apache.spark.sql.Encoders.row(kind)), spark)
