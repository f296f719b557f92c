"""Whole views of papers as one result each: what a reader sees, and what an editor sees.

What several parts of a view need (the segments, the resolved links) is made once, written to the shared folder and read
from there with the columns that each part needs; so each source is scanned once for a view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import padded
from glossa.operators import links as L
from glossa.operators import segments as S
from glossa.session import shared_folder

KEY = ["paper_id", "id"]


def shared(rows: DataFrame) -> DataFrame:
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def link_counts(resolved: DataFrame, exhibits: DataFrame) -> DataFrame:
    """(paper_id, id, accepted, candidates, labels): links of each segment; labels of accepted exhibits, sorted."""
    labelled = L.labelled_links(resolved, exhibits)
    accepted = F.col("status") == "accepted"
    return labelled.groupBy("paper_id", F.col("segmentId").alias("id")).agg(
        F.count_if(accepted).alias("accepted"), F.count_if(F.col("status") == "candidate").alias("candidates"),
        F.array_sort(F.collect_set(F.when(accepted, F.col("exhibit_label")))).alias("labels"),
    )


def reader_view(segments: DataFrame, papers: DataFrame, exhibits: DataFrame, links: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per visible segment: its place (of so many), its neighbours, the links it accepts and offers, and what the
    reader did with it. marks: (paper_id, id, seen, bookmarked, note, corrections map of exhibit to action), one row per
    segment that a reader touched; repeated papers, segments or marks are the caller's to fold."""
    segments, exhibits, marks = shared(segments), shared(exhibits), shared(marks)
    shown = S.visible(segments, papers, exhibits)
    placed = S.renumbered(S.neighbours(shown, ["paper_id"], "order", "id"), ["paper_id"], "order", to="position")
    total = shown.groupBy("paper_id").agg(F.count("*").alias("total"))
    own = marks.select("paper_id", F.col("id").alias("segment_id"), F.explode("corrections").alias("exhibit_id", "action"))
    resolved = shared(L.resolve_links(links, L.effective_corrections(own, segments), segments, exhibits).select("paper_id", "segmentId", "exhibitId", "status"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = placed.join(total, "paper_id").join(link_counts(resolved, exhibits), KEY, "left").join(marks.drop("corrections"), KEY, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        *KEY, padded("position", 3).alias("place"), "total", "previous", "next", "kind", "sourceText", count("accepted"), count("candidates"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), yes("seen"), yes("bookmarked"), "note",
    )


def editor_view(segments: DataFrame, links: DataFrame, exhibits: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per segment, excluded ones too: its states, whether it was edited here, what was merged into it, its links as
    published, and the counts of its paper. edits: (paper_id, id, sourceText), one row per edited segment."""
    segments = shared(segments)
    merged = S.merged_children(segments).groupBy("paper_id", F.col("target").alias("id")).agg(F.count("*").alias("absorbed"))
    out = F.coalesce("excluded", F.lit(False))
    counts = segments.groupBy("paper_id").agg(F.count_if(~out).alias("included"), F.count_if(out).alias("excluded_count"), F.count_if(~out & (F.col("reviewStatus") == "reviewed")).alias("reviewed"))
    none = segments.select("paper_id", F.col("id").alias("segment_id"), F.lit("").alias("exhibit_id"), F.lit("").alias("action")).filter(F.lit(False))
    resolved = L.resolve_links(links, none, segments, exhibits).select("paper_id", "segmentId", "exhibitId", "status")
    said = edits.select(*KEY, F.col("sourceText").alias("__text"))
    rows = segments.join(counts, "paper_id").join(merged, KEY, "left").join(said, KEY, "left").join(link_counts(resolved, exhibits), KEY, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        *KEY, "order", "kind", out.alias("excluded"), "reviewStatus", "translationStatus", F.coalesce("__text", "sourceText").alias("sourceText"), F.coalesce(F.col("__text") != F.col("sourceText"), F.lit(False)).alias("edited"),
        count("absorbed"), count("accepted"), count("candidates"), "included", "excluded_count", "reviewed",
    )
