"""Reader states kept up from a stream of actions, as runs of folded batches.

A micro-batch is folded to the newest value of each of its keys and stored as a run. After FANIN runs of one size the batch
that makes them FANIN writes one run of all, so that each row is written again once for every power of FANIN batches and no
batch rewrites the whole state. Which runs hold the state after n batches, and which a batch folds together, follows from
their numbers alone: a batch that runs again writes the same run again, and a write that fails leaves a run without its
mark of success, which nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANIN = 4


def fold(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The newest value of each key, by the order columns."""
    newest = F.max_by(F.struct(*order, value), F.struct(*order)).alias("__r")
    return rows.select(*key, *order, value).groupBy(*key).agg(newest).select(*key, "__r.*")


def spans(n: int, fanin: int = FANIN) -> list[tuple[int, int]]:
    """The runs (first batch, end) that hold the first n batches: the digits of n."""
    out, at, size = [], 0, 1
    while size * fanin <= n:
        size *= fanin
    while size:
        while n - at >= size:
            out.append((at, at + size))
            at += size
        size //= fanin
    return out


def folded_by(number: int, fanin: int = FANIN) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """The run that a batch writes, and the older runs that go into it."""
    run = spans(number + 1, fanin)[-1]
    return run, [s for s in spans(number, fanin) if s[0] >= run[0]]


def _path(spark: SparkSession, path: str):
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(path: str, run: tuple[int, int]) -> str:
    return f"{path}/run-{run[0]}-{run[1]}"


def saver(path: str, key: list[str], order: list[str], value: str, fanin: int = FANIN) -> Callable[[DataFrame, int], None]:
    """What stores a batch under its number. Runs that the batch before has folded together are deleted: it is committed."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            for old in folded_by(number - 1, fanin)[1]:
                target, system = _path(spark, _name(path, old))
                system.delete(target, True)
        run, parts = folded_by(number, fanin)
        names = [*key, *order, value]
        rows = [spark.read.parquet(_name(path, p)).select(*names) for p in parts]
        fold(reduce(DataFrame.unionByName, [*rows, batch.select(*names)]), key, order, value).write.mode("overwrite").parquet(_name(path, run))

    return save


def saved(spark: SparkSession, path: str, key: list[str], order: list[str], value: str, fanin: int = FANIN) -> DataFrame:
    """The states as the last whole run has them."""
    root, system = _path(spark, path)
    ends = []
    for status in system.listStatus(root):
        name = status.getPath().getName().split("-")
        if name[0] == "run" and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            ends.append(int(name[2]))
    if not ends:
        raise FileNotFoundError(f"no states under {path}")
    runs = [spark.read.parquet(_name(path, run)) for run in spans(max(ends), fanin)]
    return fold(reduce(DataFrame.unionByName, runs), key, order, value)


def autosave(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], value: str):
    """A query that keeps the states under path; `saved` reads them."""
    return stream.writeStream.foreachBatch(saver(path, key, order, value)).option("checkpointLocation", checkpoint).outputMode("append")
