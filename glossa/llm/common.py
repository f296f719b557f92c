"""What the training-data operators share: input handling, the shared folder, sizes and worker-side text splitting."""

from __future__ import annotations

import ctypes
import functools
import inspect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import shared_base, shared_folder

#: Bytes of stored input that one partition of an exchange should get.
PARTITION_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): the UTF-8 bytes of each text, null texts stay null. Other columns are dropped,
    so names that clash with an operator's own cannot matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame (file sizes for a plain scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, factor: float = 1.0) -> int:
    """How many partitions an exchange of this frame needs so that one holds about PARTITION_BYTES of stored input."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = stored_bytes(df)
    if size > 1 << 50:  # no estimate
        return least
    return max(min(least, 12), int(factor * size / PARTITION_BYTES) + 1)


def buckets_for(chunks: int) -> int:
    """How many buckets the keys of so many chunks are dealt to. Each chunk sends each bucket one packed row, so there are
    fewer buckets than chunks (a bucket gets the keys of eight, as many as a task holds), but enough for all cores."""
    return max(min(chunks, 64), chunks // 8)


def discard(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossa_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `checkpointed` wrote, once nothing that is still to run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._glossa_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """df, if every scan of it gives the same rows in the same partitions and order, else written first: what comes out of
    a shuffle has no order."""
    return checkpointed(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


@functools.cache
def _trim():
    """The C library's malloc_trim, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Gives the machine back what this worker has freed: workers are used again, and each would keep its largest task's memory."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(f):
    """A function of a group, or of a cogroup, after which the worker lets go."""

    def group(key, table):
        try:
            return f(key, table)
        finally:
            let_go()

    def cogroup(key, left, right):
        try:
            return f(key, left, right)
        finally:
            let_go()

    return group if len(inspect.signature(f).parameters) == 2 else cogroup


def parts(batches, rows: int = 1000):
    """Arrow batches cut to so many rows, so that few of them are Python objects at once. The worker lets go of what the
    task before has left, and at the end."""
    let_go()
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    let_go()


def chunk_of(id_col: str, text_col: str, n: int) -> Column:
    """The chunk (0 to n - 1) of a row by its id; rows without id are spread by their text."""
    known = F.col(id_col).cast("long")
    return F.pmod(F.xxhash64(known, F.when(known.isNull(), F.col(text_col).cast("string"))), F.lit(n)).cast("int").alias("chunk")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; each worker asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def isolated(name: str) -> str:
    """A column name that user tables do not have."""
    return f"__glossa_{name}"

