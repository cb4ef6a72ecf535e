"""What the operators of this subpackage share: shared storage, size-checked broadcast, small column helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import add
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or what setCheckpointDir() was given. Where
    neither is set, a temporary folder serves if all tasks run in this very process (master local[...]); elsewhere that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """df computed once and stored in the shared folder, its lineage cut. Spark removes the files once df is garbage, if the session
    was made with spark.cleaner.referenceTracking.cleanCheckpoints, as session() does."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_shipped: set[str] = set()
#: Of a worker process: what each module keeps between tasks, as a function that lets go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, clear: Callable[[], None]) -> None:
    """Says that a module of this package keeps something between tasks."""
    _kept[module] = clear


def _trim() -> None:
    """Gives memory that is free back to the system, as far as the C library knows how to."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _free_others(module: str) -> None:
    """Frees what other modules keep in this worker. A function of the module, not a closure: so it meets the worker's own _kept."""
    others = [clear for name, clear in _kept.items() if name != module]
    for clear in others:
        clear()
    if others:
        gc.collect()
        _trim()


def _alone(run: Callable) -> Callable:
    """run, after other modules' memory of earlier tasks is freed: a worker that serves several operators in turn holds one's at a
    time. Arrow takes its memory from the C library, which gives it back."""

    def first_free(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        _free_others(run.__module__)
        yield from run(batches)
        _trim()

    return first_free


#: Rows and bytes of texts that go to a Python worker at once, at most, where the session does not say: Spark's defaults are meant
#: for rows of a few numbers, and whole texts would fill a worker and its executor many times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, after making this package known to the executors' Python, wherever they run."""
    sc = df.sparkSession.sparkContext
    for key, value in BATCHES.items():
        if df.sparkSession.conf.get(key, None) is None:
            df.sparkSession.conf.set(key, value)
    if sc.applicationId not in _shipped:
        package = Path(__file__).parents[1]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)
    return df.mapInArrow(_alone(run), schema)


#: Bytes that a row takes in a broadcast table besides its values.
ROW_BYTES = 32


def value_bytes(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | ArrayType | StructType):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + value_bytes(x, kind.elementType)), F.lit(16).cast("long"))
        return 8 * F.greatest(F.size(c), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return reduce(add, (value_bytes(c[f.name], f.dataType) for f in kind.fields))
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """About how many bytes df (already stored, so cheap to read) would take as a broadcast table."""
    return int(df.agg(F.sum(reduce(add, (value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields)).cast("long") + ROW_BYTES)).first()[0] or 0)


def small(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """df (already stored) with a broadcast hint if it takes max_bytes at most; else df, for a shuffled join."""
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df


def free(name: str, taken: list[str]) -> str:
    """name, or the first of name_, name__, ... that is no column of taken, whatever the case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character left alone. lower() is quicker and does the same where there are no others."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(count: Column, body) -> Column:
    """[body(0), ..., body(count - 1)]; empty if count < 1 (sequence() alone would count downwards)."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), body)).otherwise(F.array())


def space_words(c: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def alnum_words(c: Column) -> Column:
    """Words of letters, digits and non-ASCII characters of a text with A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")
