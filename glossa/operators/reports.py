"""Counts over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def editor_counters(segments: DataFrame, key: str = "paper_id") -> DataFrame:
    """Included, excluded, and among the included reviewed and machine-drafted segments."""
    out = F.coalesce("excluded", F.lit(False))
    return segments.groupBy(key).agg(F.count_if(~out).alias("included"), F.count_if(out).alias("excluded"), F.count_if(~out & (F.col("reviewStatus") == "reviewed")).alias("reviewed"), F.count_if(~out & (F.col("translationStatus") == "ai-draft")).alias("drafted"))


def page_report(units: DataFrame, excluded: DataFrame, boxes: DataFrame, key: str = "paper_id") -> DataFrame:
    """Reading units, excluded records and exhibit boxes per page; each input has (key, page, id). A unit counts on every
    page that it touches."""
    counted = lambda df, name: df.groupBy(key, "page").agg(F.count_distinct("id").alias(name))
    rows = counted(units, "units").join(counted(excluded, "excluded"), [key, "page"], "full").join(counted(boxes, "boxes"), [key, "page"], "full")
    return rows.select(key, "page", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("units", "excluded", "boxes")))


def crop_counts(figures: DataFrame) -> DataFrame:
    """Figure crops: how many, in which state, and of which kind."""
    status = lambda s: F.count_if(F.col("status") == s)
    return figures.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("output").isNotNull()).alias("rendered"), status("skipped_by_tier").alias("skipped_by_tier"), status("ok").alias("ok"), status("suspect").alias("suspect"),
        status("failed").alias("failed"), F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"),
    )


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def library_cards(papers: DataFrame) -> DataFrame:
    from glossa.functions.labels import segment_count
    from glossa.functions.text import padded

    return papers.select("paper_id", padded("number", 2).alias("label"), "title", "pageCount", segment_count(F.col("bodySegmentCount"), F.col("includedSegmentCount"), F.col("segmentCount")).alias("segments"))


def view_counts(segments: DataFrame, citations: DataFrame, explanations: DataFrame, resolved: DataFrame) -> DataFrame:
    """(paper_id, id, citations, accepted, candidates, explains): what a segment's view counts, and how many exhibits it
    explains."""
    counted = lambda rows, name: rows.groupBy("paper_id", F.col("segmentId").alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = segments.select("paper_id", "id")
    for rows, name in ((citations, "citations"), (resolved.filter("status = 'accepted'"), "accepted"), (resolved.filter("status = 'candidate'"), "candidates"), (explanations.withColumnRenamed("segment_id", "segmentId"), "explains")):
        out = out.join(counted(rows, name), ["paper_id", "id"], "left")
    return out.select("paper_id", "id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("citations", "accepted", "candidates", "explains")))


def exhibit_counts(exhibits: DataFrame, explanations: DataFrame) -> DataFrame:
    """(paper_id, id, explanations) of every exhibit. explanations: as links.explanations gives them."""
    n = explanations.groupBy("paper_id", F.col("exhibit_id").alias("id")).agg(F.count(F.lit(1)).alias("explanations"))
    return exhibits.select("paper_id", "id").join(n, ["paper_id", "id"], "left").withColumn("explanations", F.coalesce("explanations", F.lit(0)))
