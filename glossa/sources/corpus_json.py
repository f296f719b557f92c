"""JSON sources: catalogue, paper documents, crop manifests, states, study pages, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa import schema
from glossa.operators.quality import BACKUP_BYTES, InvalidInput


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per paper; the catalogue must say how many papers it lists."""
    rows = spark.read.schema(schema.catalogue()).option("multiLine", True).json(path)
    wrong = rows.filter(~F.coalesce(F.col("papers").isNotNull() & (F.col("paperCount") == F.size("papers")), F.lit(False))).limit(1).count()
    if wrong:
        raise InvalidInput("the catalogue's paper count is wrong")
    return rows.select("schemaVersion", "generatedAt", F.explode("papers").alias("p")).select("schemaVersion", "generatedAt", F.col("p.id").alias("paper_id"), "p.*").drop("id")


def paper_documents(spark: SparkSession, path: str, paper_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema.paper_document()).option("multiLine", True).json(path)
    bad = F.col("segments").isNull() | (F.size("segments") == 0)
    if paper_id is not None:
        bad = bad | ~F.col("id").eqNullSafe(F.lit(paper_id))
    if rows.filter(bad).limit(1).count():
        raise InvalidInput("a paper document has another id or no segments")
    return rows


def segments(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), F.explode("segments").alias("s")).select("paper_id", "s.*")


def exhibits(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), F.posexplode("exhibits").alias("position", "e")).select("paper_id", "position", "e.*")


def links(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), F.posexplode("exhibitCompanion.links").alias("position", "l")).select("paper_id", "position", "l.*")


def citations(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), F.explode("citations").alias("c")).select("paper_id", "c.*")


def references(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), F.posexplode("references").alias("position", "r")).select("paper_id", "position", "r.*")


def papers(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("paper_id"), "title", F.col("sourceSha256").alias("source_sha256"), F.col("readingQuality").isNotNull().alias("has_quality"), F.col("exhibitCompanion").isNotNull().alias("has_companion"), F.coalesce("inlineExhibitsEnabled", F.lit(False)).alias("inline"))


def crops(spark: SparkSession, path: str) -> DataFrame:
    """Crop records of all manifests; the paper comes from the manifest or else from its folder's name."""
    rows = spark.read.schema(schema.crop_manifest()).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    name = F.coalesce("paperId", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return rows.select(name.alias("paper_id"), F.explode("figures").alias("f")).select("paper_id", "f.*")


def study_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.study_page()).option("multiLine", True).json(path)


def parsed_states(rows: DataFrame, json_col: str, kind: str) -> DataFrame:
    """States from stored text; missing or broken text gives a null state (the caller's defaults then hold)."""
    types = {"reader": schema.reader_state, "companion": schema.companion_state, "paper": schema.paper_document}
    return rows.withColumn("state", F.from_json(json_col, types[kind](), {"mode": "PERMISSIVE"}))


def companion_backups(spark: SparkSession, path: str, most: int = BACKUP_BYTES) -> DataFrame:
    """(path, state) of backup files of at most so many bytes."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)
    return files.select("path", F.from_json(F.decode("content", "UTF-8"), schema.companion_state()).alias("state"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of PDF files; text extraction needs a PDF library, which isn't a dependency."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "content")


def template(spark: SparkSession, path: str) -> str:
    got = spark.read.option("wholetext", True).text(path).first()
    if got is None:
        raise InvalidInput(f"no template at {path}")
    return got.value
