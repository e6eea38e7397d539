"""The shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[int, str] = {}
_open: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since a machine's own folder isn't
    seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _own:
        kept = tempfile.TemporaryDirectory(prefix="polycat-")
        atexit.register(kept.cleanup)
        _own[key] = f"file://{kept.name}"
    return _own[key]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let go of what earlier steps left on the driver.

    Spark deletes broadcasts and shuffle files once the driver's garbage collection finds that nobody refers to
    them any more.  Between the steps of a long job that is done here, and the heap that is free then
    goes back to the machine, where the JVM can be told to do so.
    """
    gc.collect()
    jvm = spark._jvm
    try:
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        for name, percent in (("MinHeapFreeRatio", "20"), ("MaxHeapFreeRatio", "30")):
            options.setVMOption(name, percent)
    except Py4JJavaError:
        pass  # another JVM: it keeps its heap
    jvm.java.lang.System.gc()


#: Hadoop's settings for intermediate tables.  In a plain folder Hadoop starts a process (chmod) for each file and folder that it makes, and
#: until that process runs its own program it shares, and is counted with, all memory of the executor that starts it.  So these tables, which
#: are soon deleted, go without checksum files and _SUCCESS: two such processes a file in the executors, not three.  (Hadoop
#: then doesn't verify what is read of them.)  Stores other than plain folders write as they always do.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


class Workspace:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    They stay until ``drop`` or the end of a ``Scope``: a result that an operator
    returns is computed from them when it is used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/polycat/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        for scope in _open.get():
            scope.made.append(self.base)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again, with its lineage cut."""
        path = f"{self.base}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").options(**PLAIN_FILES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        self.names.discard(name)
        _delete(self.spark, f"{self.base}/{name}")

    def keep(self, *names: str) -> None:
        """Delete all tables but those that the result is computed from."""
        for name in self.names - set(names):
            self.drop(name)


class Scope:
    """The workspaces that are made while it is open, by whoever opened it and nobody else.

    ``with Scope(spark): ...`` deletes their tables at the end; results that read them
    must be written elsewhere before.  Other threads' workspaces aren't touched, and
    scopes may be nested.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __enter__(self) -> Scope:
        self._token = _open.set((*_open.get(), self))
        return self

    def __exit__(self, *error) -> None:
        _open.reset(self._token)
        self.release()

    def release(self) -> None:
        """Delete the tables of the workspaces made so far."""
        while self.made:
            _delete(self.spark, self.made.pop())
