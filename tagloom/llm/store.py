"""Where tables and files that outlive one Spark job go: the shared folder of the cluster.

The folder is the one named in ``spark.checkpoint.dir``. Only where that setting is
absent, and only in local mode, a temporary folder takes its place; on a cluster
without the setting the operators refuse to run, since executors can't see each
other's local disks.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: The tables that the innermost finished() of this thread deletes.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("tables_on_the_way", default=None)


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; also made the context's checkpoint folder if it has none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.get(sc.applicationId)
        if root is None:
            root = _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tagloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, not yet created."""
    return f"{shared_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut in the lineage
    that survives the loss of any executor."""
    path = fresh_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    give_back(df.sparkSession)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    on_the_way = _scope.get()
    if on_the_way is not None:
        on_the_way.append(made)
    return made


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns as a written table, without the tables that were written on the way.
    Each thread has its own, so operators can run side by side."""
    on_the_way: list[DataFrame] = []
    outer = _scope.set(on_the_way)
    try:
        df = make()
    finally:
        _scope.reset(outer)
    made = materialise(df, name)
    for table in on_the_way:
        discard(table)
    return made


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by materialise(), once nothing reads it any more; a second
    time nothing happens. Spark deletes the shuffle files of plans that are gone when the driver
    collects its garbage, which a large heap may put off for long, so this asks for it."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()
    give_back(df.sparkSession)


def give_back(spark: SparkSession) -> None:
    """Let the driver, its JVM and this process, return native memory that it has freed. Every query's planning,
    compiling and results leave some, which the C library keeps for each of the driver's hundreds of threads."""
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    lang, management = jvm.java.lang, jvm.javax.management
    server, of = lang.management.ManagementFactory.getPlatformMBeanServer(), lang.Class.forName
    kinds = gateway.new_array(lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(name)
    asked = gateway.new_array(lang.Object, 4)
    asked[0], asked[1] = management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by the interface, as the server's class is not public
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, asked)
    except Py4JJavaError:  # a JVM or C library without this command
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage and return the heap that is free then. A heap that earlier tasks
    have grown is kept otherwise, beside the Python workers that need memory now. There is a task for each core, which
    a scheduler deals to all executors; one that gets none keeps its heap."""
    cores = spark.sparkContext.defaultParallelism
    asked = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("gc"))
    asked.write.format("noop").mode("overwrite").save()


def make_dir(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI of the shared folder; used on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tagloom_shipped", None) == sc.applicationId:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tagloom-code-")), "tagloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._tagloom_shipped = sc.applicationId


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches sent to Python, so that long texts don't fill a worker;
    and make sure that workers have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def _libc():
    """The C library where it is glibc, whose allocator can be told to give memory back."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim, libc.mallopt  # noqa: B018
    except (OSError, AttributeError):
        return None
    return libc


def tidy(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """A function of batches after which the worker process, which is kept for later tasks, gives its free
    memory back. Large arrays are mapped on their own, so that they leave no holes in the heap. A task
    that doesn't encode lets go of the encoder that earlier ones left."""

    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
        tokenise = sys.modules.get("tagloom.llm.tokenise")
        if tokenise is not None and not encodes and tokenise.release() and libc is not None:
            libc.malloc_trim(0)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return wrapped


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, that name or a variant of it that no column of df has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
