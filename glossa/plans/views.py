"""Adapter views: the driver's star schema and documents in the shape of a paper corpus, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores, where a table of few splits is to be worked on for long; tables of many splits stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, written once for views that need them several times."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("is_labelled", F.lit(True)), "doc_id", "left")
    path = shared_folder(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def papers(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    if docs is not None:
        return docs.select(F.col("doc_id").alias("paper_id"), F.coalesce("is_labelled", F.lit(False)).alias("has_quality"), (F.col("doc_id") % 2 == 0).alias("has_companion"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has_quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("paper_id"), F.coalesce("has_quality", F.lit(False)).alias("has_quality"), (F.col("doc_id") % 2 == 0).alias("has_companion"))


def segments(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    lines = F.posexplode(F.split("text", "\n")).alias("pos", "sourceText")
    if docs is not None:
        rows = docs.select("doc_id", "lang", "quality", "toxic", lines)
    else:
        rows = table(spark, sf_dir, "documents").select("doc_id", "lang", lines).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    order = (F.col("pos") + 1).cast("long")
    return rows.select(
        F.col("doc_id").alias("paper_id"), F.concat("doc_id", F.lit("-"), order.cast("string")).alias("id"), order.alias("order"), "sourceText", "lang",
        F.when(order == 1, "heading").when(order % 7 == 0, "caption").otherwise("body").alias("kind"), (F.col("toxic") == 1).alias("excluded"),
        F.when(order == 1, "title").alias("readingRole"), F.when(F.col("quality") == 1, "reviewed").otherwise("needs-review").alias("reviewStatus"),
        F.when(order % 2 == 0, "ai-draft").otherwise("untranslated").alias("translationStatus"),
    )


def exhibits(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = (table(spark, sf_dir, "documents") if docs is None else docs).filter((F.col("doc_id") % 3 == 0) & (F.size(F.split("text", "\n")) >= 3))
    return docs.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("e"), "doc_id").alias("id"), F.concat("doc_id", F.lit("-3")).alias("captionSegmentId"), F.lit(0).alias("position"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with one row per (order, part group)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("segment"), (F.col("l_partkey") % 100).alias("exhibit"))
    return rows.agg(F.min("l_linestatus").alias("method"), F.when(F.min("l_returnflag") == "A", "candidate").otherwise("high").alias("confidence"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error"))
    return rows.select(F.col("event_id").alias("segment"), F.get_json_object("props", "$.k").cast("long").alias("exhibit"), F.when(F.col("event_type") == "click", "include").otherwise("exclude").alias("action"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


SEGMENTS = """segs AS (SELECT d.doc_id AS paper_id, d.doc_id || '-' || o AS id, o AS ord, parts[o] AS "sourceText", lang,
  CASE WHEN o = 1 THEN 'heading' WHEN o % 7 = 0 THEN 'caption' ELSE 'body' END AS kind, toxic = 1 AS excluded,
  CASE WHEN o = 1 THEN 'title' END AS role, CASE WHEN quality = 1 THEN 'reviewed' ELSE 'needs-review' END AS review,
  CASE WHEN o % 2 = 0 THEN 'ai-draft' ELSE 'untranslated' END AS translation
  FROM (SELECT doc_id, lang, parts, unnest(range(1, len(parts) + 1)) AS o FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)) d
  LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
VISIBLE = (
    SEGMENTS
    + """, vis AS (SELECT * FROM segs s WHERE NOT coalesce(excluded, false)
  AND NOT (role IS NOT NULL AND paper_id IN (SELECT doc_id FROM labels))
  AND NOT (paper_id % 2 = 0 AND (kind = 'caption' OR (paper_id % 3 = 0 AND ord = 3))))"""
)
PAIRS = """pairs AS (SELECT l_orderkey AS segment, l_partkey % 100 AS exhibit, min(l_linestatus) AS method,
  CASE WHEN min(l_returnflag) = 'A' THEN 'candidate' ELSE 'high' END AS confidence FROM lineitem GROUP BY 1, 2)"""
ACTIONS = "acts AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
CORRECTIONS = ACTIONS + ", corr AS (SELECT event_id AS segment, k AS exhibit, CASE WHEN event_type = 'click' THEN 'include' ELSE 'exclude' END AS action FROM acts WHERE event_type IN ('click', 'error'))"
