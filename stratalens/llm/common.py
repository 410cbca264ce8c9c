"""What the training-data operators share: tables, shared storage, Arrow slices."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token of the corpus statistics: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Folders made for sessions on one machine that name none, by application.
MADE: dict[str, str] = {}
#: Paths of the tables written on the way to a condensed one; None outside of that.
PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark from any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset on one machine, as in tests, a temporary
    folder is made once. On a cluster that is an error: a folder of one
    machine would lose what executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId  # the setting itself cannot change while a session runs
        found = MADE.get(app) or MADE.setdefault(app, "file://" + tempfile.mkdtemp(prefix="stratalens-"))
    return found


def few_files(df: DataFrame, waves: int = 4) -> DataFrame:
    """Read what a shuffle dealt out in ``waves`` tasks a core at most.

    For narrow results of aggregates and joins: many small files cost more than
    they help. Each task takes several shuffle partitions one after the other, so
    the memory it needs stays that of one partition.
    """
    return df.coalesce(max(1, waves * df.sparkSession.sparkContext.defaultParallelism))


def materialize(df: DataFrame, tag: str, gathered: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends at files.

    Unlike cached blocks the files outlive any executor, and what is read back
    has one fixed content however often later stages are retried. ``gathered``:
    narrow rows that come out of a shuffle, written in few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (passing := PASSING.get()) is not None:
        passing.append(path)
    (few_files(df, 1) if gathered else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def condensed(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` returns, written by :func:`materialize`; the tables that it wrote on the way are deleted.

    Only the written result may be read afterwards. It does not depend on the deleted
    tables, so lost executors cost nothing then either. Should ``make`` or the writing
    fail, the tables stay.
    """
    token = PASSING.set(passing := [])
    try:
        found = make()
    finally:
        PASSING.reset(token)
    kept = materialize(found, tag, gathered=True)
    context = found.sparkSession.sparkContext
    for name in passing:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its long or binary key passed through an expression that changes nothing.

    The result of an aggregate is known to be dealt out by its key, so a join on that
    key would bring all rows of a hot key from the other side to one task. Behind the
    expression Spark deals both sides out for the join itself, where it can split
    large partitions, or broadcasts this side if it turns out small.
    """
    same = F.concat(key, F.unhex(F.lit(""))) if dict(df.dtypes)[key] == "binary" else F.col(key).bitwiseXOR(F.lit(0).cast("long"))
    return df.withColumn(key, same)


def row_id() -> Column:
    """A number for each row of one scan.

    A second scan may cut its files into other splits, as when an executor was lost
    or came late: what is numbered once and met again is written first (:func:`numbered`).
    """
    return F.monotonically_increasing_id()


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it, so that no column is called so."""
    lower = {c.lower() for c in columns}
    while name.lower() in lower:
        name = "_" + name
    return name


def numbered(df: DataFrame, tag: str, name: str) -> DataFrame:
    """``df`` with row numbers in the new column ``name``, written once, so that every later step reads the same."""
    return materialize(df.withColumn(name, row_id()), tag)


def keyed(df: DataFrame, tag: str, name: str) -> DataFrame:
    """``df`` with a key of each row, the same in every scan, in the new column ``name``.

    A row of a plain Parquet scan is known by its file (a 64-bit hash of the path) and
    its number in the file, which no split changes. Other frames are numbered and written.
    """
    if "_metadata" not in df.columns and df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
        except AnalysisException:  # a format without row numbers
            pass
    return numbered(df, tag, name)


def hash_mod(col: Column, n: int, seed: int = 0) -> Column:
    """A bucket 0..n-1 from a 64-bit hash."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(n)).cast("int")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df`` of a session that hands ``rows`` rows at most to a Python worker at a time.

    The default of 10,000 texts is tens of megabytes in the executor and again in the
    worker. A smaller setting is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > rows:
        conf.set(name, str(rows))
    return df


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most_bytes`` a slice.

    A row is never cut: a slice has one row at least, however long its text.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.num_rows else []
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def crc_remainder(id_col: Column, n: int) -> Column:
    """crc32 of the decimal id, modulo ``n``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))
