"""Helpers shared by the corpus operators: shared tables, literal tables, text keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def release(spark: SparkSession) -> None:
    """Let the driver collect what finished jobs have left: Spark then drops the shuffle files and broadcasts that
    nothing refers to any more, and the heap shrinks, which in a long run of stages would only grow. What the driver
    has free of its heap and of the C library's goes back to the system, as far as its JVM can do that."""
    with contextlib.suppress(Py4JError):
        bean = _bean(spark, "com.sun.management:type=HotSpotDiagnostic")
        for option, percent in (("MinHeapFreeRatio", "10"), ("MaxHeapFreeRatio", "25")):
            bean("setVMOption", option, percent)
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JError):
        _bean(spark, "com.sun.management:type=DiagnosticCommand")("systemTrimNativeHeap")


def _bean(spark: SparkSession, name: str):
    """(operation, *strings) of a bean of the driver's JVM, called through the public interface of its server."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    server, kind = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.java.lang.Class.forName

    def filled(of, values: list):
        out = array(of, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    types = filled(jvm.java.lang.Class, [kind(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")])
    method = kind("javax.management.MBeanServer").getMethod("invoke", types)

    def call(operation: str, *given: str):
        own = [filled(jvm.Object, list(given)), filled(jvm.String, ["java.lang.String"] * len(given))]
        return method.invoke(server, filled(jvm.Object, [jvm.javax.management.ObjectName(name), operation, *own]))

    return call


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share, for a run that begins; what
    earlier ones have left is released. The folder goes when the driver ends.

    Where the setting is absent, a local session gets a temporary folder that goes at exit;
    any other session is refused, since its executors would not see each other's files.
    """
    release(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    local = not base
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridkin-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/gridkin-{uuid.uuid4().hex}"
    if not local:
        path, files = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def _files(spark: SparkSession, folder: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for name in names:
        path, files = _files(spark, f"{folder}/{name}")
        files.delete(path, True)


#: Rows and bytes that a Python worker gets at a time, so that long texts do not add up.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound what they get at a
    time (where the session leaves Spark's own bound)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    home = str(Path(__file__).resolve().parents[2])
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *paths])


def give_back() -> None:
    """Return memory that is free again to the system: workers and the driver live on after a task's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: read often, computed once, no lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A small table whose rows are constants of the plan; schema: (name, SQL type) pairs."""
    fields = ", ".join(f"`{n}` {t}" for n, t in schema)
    text = json.dumps([dict(zip([n for n, _ in schema], r, strict=True)) for r in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{fields}>>")
    return spark.range(1, numPartitions=1).select(F.inline(parsed))


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, every other character stays. lower() is much faster than translate() and
    does the same wherever a text has one byte for each character."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
