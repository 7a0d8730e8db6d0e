"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs in one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> list[tuple[SparkSession, str]]:
    """The tables made by written() that are still there."""
    return list(_written)


def release(tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete tables made by written(), all of them if none are named; only when nothing that reads them is still wanted."""
    for spark, path in list(_written) if tables is None else tables:
        if (spark, path) in _written:
            _written.remove((spark, path))
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(n))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_words(text: pa.Array | pa.ChunkedArray, *, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of all texts one after the other, the distinct words, and len(text)+1 offsets into the codes."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    text = pc.ascii_lower(text) if lower else text
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(flat)
    codes, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes -= codes > empty
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return codes, words, offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment, empty ones included."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def seg_max(values: np.ndarray, offsets: np.ndarray, empty: float = 0.0) -> np.ndarray:
    out = np.full(len(offsets) - 1, empty)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, offsets[:-1][full])
    return out


def pieces(batches, column: str = "text", most: int = 4_000_000):
    """The batches cut so that a piece holds about ``most`` bytes of the text column (a longer text is a piece of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.take(pa.array(np.arange(lo, hi)))  # a copy: string kernels misread slices


@contextlib.contextmanager
def roomy():
    """Within, the process keeps what freed arrays of some megabytes leave, where its C library can be told to; at the end it is returned.

    Else a fresh process takes the same memory from the system page by page
    again and again: a fifth of the time to train.
    """
    try:
        libc = ctypes.CDLL(None)
        tell = libc.mallopt
        back = libc.malloc_trim
    except (OSError, AttributeError, TypeError):
        yield
        return
    for kind in (-3, -1):  # the sizes from which memory comes from and goes back to the system
        tell(kind, 64 << 20)
    try:
        yield
    finally:
        tell(-3, 32 << 20)  # where the library itself ends up once large arrays were freed
        tell(-1, 64 << 20)
        back(0)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application: they need not have it installed."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='kindred-')}/kindred", "zip", root, "kindred")
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)


_shared: list = []


def share(spark: SparkSession, value):
    """Broadcast a model whose size the caller bounds."""
    ship(spark)
    _shared.append(spark.sparkContext.broadcast(value))
    return _shared[-1]


def tidy(spark: SparkSession) -> None:
    """Give back what finished work holds.

    Executors drop their copies of shared models (a frame that still needs one
    fetches it again), and a collection on both sides of the driver lets Spark's
    cleaner drop plans, shuffles and generated code, which otherwise wait for
    one.
    """
    while _shared:
        with contextlib.suppress(Exception):  # its session may have ended
            _shared.pop().unpersist()
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """A collection on both sides of the driver: until one, shuffle files of finished work stay on disk."""
    gc.collect()
    spark._jvm.System.gc()
    with contextlib.suppress(Exception):
        trim(spark)


def trim(spark: SparkSession) -> str:
    """Have the driver's JVM return native memory that it has freed, by the management command of Java 17.0.9 and later on Linux; fails where there is none.

    What compiling the code of many plans takes is freed piecemeal and stays
    with the process, more after each stage.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    kinds = new(jvm.java.lang.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
    args = new(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
