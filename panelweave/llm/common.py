"""Shared plumbing of the corpus operators: storage, folds, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of a Python worker handles, so that memory doesn't follow the Arrow batch.
SLICE_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a single-process local session may go without that setting; it then gets a
    folder of its own under the system's temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


#: Rows of an Arrow batch between the JVM and Python, and of a batch that is read from a file: whole texts may be long.
BATCH_ROWS, READ_ROWS = 1024, 512


def ship(spark: SparkSession) -> None:
    """Ready a session: executors can import this package, batches of texts stay small, and an ended
    query's shuffle files go.

    The package goes out once for each Spark context; a batch size that the session set itself is kept. A batch of
    4096 texts takes arrays of some 10 MB, for which the JVM's heap grows and stays large.
    What the driver has freed since the last operator goes back to the system.
    """
    relieve(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, BATCH_ROWS)
    size = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(size) == "4096":
        spark.conf.set(size, READ_ROWS)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._package_shipped = True


#: Seconds between two times that the driver hands memory back; at least so many times what the last one took.
RELIEF, RELIEF_SHARE = 5.0, 20
_RELIEF_DUE = [0.0]


def relieve(spark: SparkSession) -> None:
    """Hand back what the driver's Python and JVM have freed, unless that was done within RELIEF seconds.

    Hundreds of short jobs leave the JVM a heap that grew for garbage, and the C library some 200 MB of pieces that
    compilers and network buffers no longer use: each thread's arena keeps its own. A JVM that doesn't have the
    command for that (an older one, or elsewhere than on Linux) only collects its garbage.
    """
    began = time.monotonic()
    if began < _RELIEF_DUE[0]:
        return
    _give_back()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    # The server's class is not public: its method is taken from the interface.
    kinds = "javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"
    types, values = new(jvm.java.lang.Class, len(kinds)), new(jvm.java.lang.Object, len(kinds))
    for i, kind in enumerate(kinds):
        types[i] = jvm.java.lang.Class.forName(kind)
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    for i, value in enumerate((command, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0))):
        values[i] = value
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:  # not this JVM
        pass
    ended = time.monotonic()
    _RELIEF_DUE[0] = ended + max(RELIEF, RELIEF_SHARE * (ended - began))


#: Rows of a file of a table of narrow rows.
FILE_ROWS = 500_000


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), narrow: bool = False, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage durably.

    codec: lz4_raw takes less time for rows that are packed already.

    narrow: rows are few bytes each; they are counted first and written as files of FILE_ROWS, not one for each task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if narrow:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.coalesce(max(1, -(-kept.count() // FILE_ROWS))).write.option("compression", "zstd").parquet(path)
        kept.unpersist()
    else:
        writer = df.write.option("compression", codec)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None, part: str = "") -> None:
    """Delete tables that materialize wrote, or the folder `part` of them, once nothing that is still to run reads them."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the id's text has remainder 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus) == F.lit(2), F.lit(False))


_STATE: dict[str, object] = {}


def worker_state(name: str, make):
    """What a Python worker keeps between tasks under this name; only one thing is kept at a time.

    A worker serves many operators in turn, and what each remembers would add up: where the
    name changes, the old one goes and its memory is handed back before the new one is made.
    """
    if name not in _STATE:
        release()
        _STATE[name] = make()
    return _STATE[name]


def state_name(kind: str) -> str:
    """A name for worker_state that no other column or operator has."""
    return f"{kind} {uuid.uuid4().hex}"


def tidy(work, keeps: bool = False):
    """A map over Arrow batches that hands freed memory back to the system when its task ends.

    keeps: it uses worker_state; a map that doesn't first drops what others have left there.
    """

    def run(batches):
        _lean()
        if not keeps:
            release()
        try:
            yield from work(batches)
        finally:
            _give_back(every=10.0 if keeps else 0.0)

    return run


def grouped(work):
    """The same for a function of a group's rows; groups may be many and small, so memory goes back every other second at most."""

    def run(pdf):
        release()
        try:
            return work(pdf)
        finally:
            _give_back(every=2.0)

    return run


def release() -> None:
    """Drop what others have left in the worker."""
    _lean()
    if _STATE:
        _STATE.clear()
        _give_back()


#: A worker below this many MB is left alone.
_SMALL_MB = 150
#: An option of the C library's allocator: M_ARENA_MAX.
_ARENAS = -8
_LEAN: list[bool] = []
_GIVEN = [0.0]


def _lean() -> None:
    """Once a worker: one arena, and Arrow's buffers by the same allocator, so that what is freed can go back."""
    if _LEAN:
        return
    _LEAN.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(_ARENAS, 1)
    except (OSError, AttributeError):  # not this C library
        pass


def _give_back(every: float = 0.0) -> None:
    """Collect what nothing refers to and hand it to the system; not again within `every` seconds."""
    now = time.monotonic()
    if now < _GIVEN[0] + every:
        return
    _GIVEN[0] = now
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < _SMALL_MB << 20:
                return
    except OSError:
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def slices(batches, rows: int = SLICE_ROWS):
    """Cut Arrow batches into smaller ones without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pack_deltas(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, seven bits a byte, low bits first."""
    values = np.asarray(values, dtype=np.uint64)
    gaps = np.diff(values, prepend=np.uint64(0))
    return pack_varints(gaps)


def pack_varints(values: np.ndarray) -> bytes:
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return b""
    width = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        width += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    starts = ends - width
    for k in range(int(width.max())):
        some = np.flatnonzero(width > k)
        part = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        more = (width[some] > k + 1).astype(np.uint8) << 7
        out[starts[some] + k] = part.astype(np.uint8) | more
    return out.tobytes()


def unpack_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    width = last - starts + 1
    out = np.zeros(len(last), dtype=np.uint64)
    for k in range(int(width.max())):
        some = np.flatnonzero(width > k)
        out[some] |= (raw[starts[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def unpack_deltas(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_varints(data), dtype=np.uint64)
