"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only where all of Spark is this one machine's process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='motifmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def released(spark: SparkSession) -> bool:
    """Has the driver's JVM give back the memory of jobs that are over, once its heap has grown by a sixteenth of the most it may take.

    Each stage puts its task binary into blocks of megabytes, so a burst of small stages makes the heap grow to
    several times what is held, and it keeps that.  Collecting also lets go of shuffles and broadcasts that nothing needs.
    """
    jvm, application = spark.sparkContext._jvm, spark.sparkContext.applicationId
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - _HEAP.get(application, 0) <= heap.maxMemory() // 16:
        return False
    jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # memory outside the heap; other JVMs have no such command
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        asked = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    _HEAP[application] = heap.totalMemory()
    return True


#: Bytes of the driver's heap after it was last released, by application.
_HEAP: dict[str, int] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    released(spark)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place from 0 in the order, by ranges of it and the sizes of the ranges before: no window runs over all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per range
    sizes = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return cut.join(F.broadcast(sizes), "__part").withColumn(name, place).drop("__part", "__before")
