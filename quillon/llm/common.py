"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import weakref

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids or of short keys that one broadcast may hold (about 16 bytes a row as a long hash map).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) a local one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    out = df.checkpoint()
    # the shuffles behind it are garbage now; Spark deletes their files when the driver's collector finds them
    del df
    give_back(out.sparkSession)
    return out


def give_back(spark: SparkSession) -> None:
    """Collects the driver's garbage, in Python and in its JVM, and gives the memory that their C libraries keep back to the system.

    The JVM's compiler and class loader leave hundreds of MB free in the C library's arenas, which last as long as the driver.
    """
    gc.collect()
    trim()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        _trim_jvm(spark.sparkContext._gateway)
    except Py4JError:  # a JVM without this command
        pass


def _trim_jvm(gateway) -> str:
    """What the JVM's diagnostic command says that trims its C library's arenas; called through the interface, as its class is in no open package."""
    jvm = gateway.jvm
    named = jvm.java.lang.Class.forName
    text, name = named("java.lang.String"), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    kinds[0], kinds[1], kinds[2], kinds[3] = name.getClass(), text, named("[Ljava.lang.Object;"), named("[Ljava.lang.String;")
    values[0], values[1] = name, "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)


def trim() -> None:
    """Gives back what Arrow and the C library keep of freed memory in this Python process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most ``most`` rows; beyond that Spark shuffles it.

    df should be cheap to count (checkpointed, or an aggregate of one).
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Remembered(dict):
    """What a Python worker remembers from one task to the next, so that it need not be made again."""

    def __init__(self):
        super().__init__()
        _remembered.append(weakref.ref(self))


_remembered: list[weakref.ref] = []


def only(*used: Remembered) -> None:
    """Forgets what this worker remembers for operators whose tasks it ran before, and gives its memory back; called when a task begins.

    What the task before has freed goes back too, though nothing was remembered: the C library keeps it else.
    """
    gone = False
    for ref in _remembered:
        if (memory := ref()) is not None and memory and not any(memory is u for u in used):
            memory.clear()
            gone = True
    if gone:
        gc.collect()
    trim()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts(df: DataFrame, least: int = 0) -> int:
    """How many partitions a shuffle in df's session should have, ``least`` at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
