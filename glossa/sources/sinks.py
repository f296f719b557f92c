"""Sinks: JSON, Markdown and HTML texts, and states that replace each other.

A forced write goes to a folder beside its target and takes the target's place by renaming when it is whole: until then the
old version stands, and a write that fails leaves it as it was. A driver that dies between the two renames leaves the old
version beside its name, where the next write, or `recovered`, puts it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import trim_script
from glossa.operators.quality import InvalidInput, curated_document, html_name_ok, require
from glossa.operators.segments import pages


_OLD, _NEW = ".replaced-", ".staged-"


def _named(spark: SparkSession, path: str):
    out = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def recovered(spark: SparkSession, path: str) -> None:
    """Puts an old version back that a dead writer left beside a missing target."""
    target, files = _named(spark, path)
    if not files.exists(target):
        left = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{_OLD}*"))
        if left:
            files.rename(left[0].getPath(), target)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes beside a target and then puts the new version in its place."""
    recovered(spark, path)
    mark, (target, files) = uuid.uuid4().hex, _named(spark, path)
    staged, old = (_named(spark, f"{path.rstrip('/')}{kind}{mark}")[0] for kind in (_NEW, _OLD))
    try:
        write(staged.toString())
        if files.exists(target) and not files.rename(target, old):
            raise OSError(f"{path} can't be moved away")
        if not files.rename(staged, target):
            raise OSError(f"{path} can't be put in its place")
    except BaseException:
        files.delete(staged, True)
        recovered(spark, path)
        raise
    files.delete(old, True)


def _save(rows: DataFrame, path: str, force: bool, save: Callable[[DataFrameWriter, str], None]) -> None:
    """Spark's commit makes a first write whole; an existing target is refused unless the write is forced."""
    if force:
        replaced(rows.sparkSession, path, lambda to: save(rows.write.mode("errorifexists"), to))
    else:
        save(rows.write.mode("errorifexists"), path)


def write_text(rows: DataFrame, path: str, col: str, force: bool = False) -> None:
    """One text per row."""
    _save(rows.select(col), path, force, lambda w, to: w.option("lineSep", "\n").text(to))


def to_json(x: Column) -> Column:
    """JSON text with explicit nulls."""
    return F.to_json(x, {"ignoreNullFields": "false"})


def export_curated(stored: DataFrame, source: DataFrame, path: str, force: bool = False) -> None:
    """Edited documents as `{id}-curated` folders of JSON, after validation."""
    ok = require(curated_document(stored, source))
    named = ok.withColumn("name", F.concat("id", F.lit("-curated")))
    _save(named, path, force, lambda w, to: w.option("ignoreNullFields", "false").partitionBy("name").json(to))


def imported_curated(store: DataFrame, incoming: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with the incoming documents that pass validation in place of its own of the same id, and (id, error) of those
    that don't."""
    judged = curated_document(incoming, source)
    good = judged.filter("error is null").drop("error")
    return store.join(good.select("id"), "id", "left_anti").unionByName(good), judged.filter("error is not null").select("id", "error")


def export_states(states: DataFrame, path: str, force: bool = False) -> None:
    _save(states, path, force, lambda w, to: w.option("ignoreNullFields", "false").json(to))


def persist(states: DataFrame, path: str) -> None:
    """States by paper, stamped; the papers written replace their old ones, others stay."""
    stamped = states.withColumn("updatedAt", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id").parquet(path)


def without(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids, "paper_id", "left_anti")


def notes_markdown(segments: DataFrame, state: DataFrame, documents: DataFrame, now: Column | None = None) -> DataFrame:
    """(paper_id, reader_id, markdown): a header and one section per segment with a note or bookmark, in reading order,
    excluded segments too. state: (paper_id, reader_id, notes, bookmarks, understood); documents: (paper_id, title,
    sourceFileName, sourceSha256). Notes are looked up by a join on the segment id, so a paper isn't crossed with readers."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if now is None else now
    key = ["paper_id", "reader_id"]
    notes = state.select(*key, F.explode("notes").alias("id", "note")).select(*key, "id", trim_script("note").alias("note")).filter("note <> ''")
    marks = state.select(*key, F.explode(F.array_distinct("bookmarks")).alias("id")).withColumn("marked", F.lit(True))
    done = state.select(*key, F.explode(F.array_distinct("understood")).alias("id")).withColumn("done", F.lit(True))
    held = notes.join(marks, [*key, "id"], "full").join(done, [*key, "id"], "left")
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "是").otherwise("否")
    rows = held.join(segments.select("paper_id", "id", "order", "section", pages().alias("pages")), ["paper_id", "id"])
    lines = F.concat_ws(
        "\n", F.concat(F.lit("## "), F.coalesce("section", F.lit("")), F.lit(" · 第 "), "pages", F.lit(" 頁")), F.lit(""), F.concat(F.lit("- 段落 ID：`"), "id", F.lit("`")),
        F.concat(F.lit("- 書籤："), yes(F.col("marked"))), F.concat(F.lit("- 已理解："), yes(F.col("done"))), F.lit(""), F.when(F.col("note").isNotNull(), F.concat("note", F.lit("\n"))),
    )
    body = rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", lines.alias("md")))), lambda x: x["md"]), "\n").alias("body"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("- 來源檔案："), F.coalesce("sourceFileName", F.lit(""))), F.concat(F.lit("- 來源 SHA-256：`"), F.coalesce("sourceSha256", F.lit("")), F.lit("`")), F.concat(F.lit("- 匯出時間："), now), F.lit(""))
    return state.select(*key).join(body, key, "left").join(documents, "paper_id").select(*key, F.concat_ws("\n", head, "body").alias("markdown"))


def write_html(rows: DataFrame, path: str, force: bool = False) -> None:
    """(name, html) rows as text folders; every name must end in .html or .htm."""
    if rows.filter(~html_name_ok(F.col("name"))).limit(1).count():
        raise InvalidInput("output names must end in .html or .htm")
    _save(rows.select("name", F.col("html").alias("value")), path, force, lambda w, to: w.partitionBy("name").text(to))
