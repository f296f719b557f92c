"""Segments: what is read, in which order, and where a segment id leads.

Tables: segments(paper_id, id, order, kind, excluded, readingRole, mergedIntoSegmentId, ...), exhibits(paper_id, id,
captionSegmentId, ...), papers(paper_id, has_quality, has_companion).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import filled


def included(segments: DataFrame) -> DataFrame:
    return segments.filter(~F.coalesce("excluded", F.lit(False)))


def visible(segments: DataFrame, papers: DataFrame, exhibits: DataFrame) -> DataFrame:
    """The reading sequence: not excluded; in papers with quality data, without a reading role; in papers with a
    companion, neither of kind caption nor an exhibit's caption. An empty role counts as none."""
    flags = papers.select("paper_id", "has_quality", "has_companion")
    kept = included(segments).join(flags, "paper_id", "left")
    kept = kept.filter(~F.coalesce("has_quality", F.lit(False)) | filled("readingRole").isNull())
    companion = F.coalesce("has_companion", F.lit(False))
    kept = kept.filter(~companion | ~F.coalesce(F.col("kind") == "caption", F.lit(False)))
    captions = exhibits.join(flags.filter("has_companion"), "paper_id", "left_semi").select("paper_id", F.col("captionSegmentId").alias("id")).filter("id is not null").distinct()
    return kept.join(captions, ["paper_id", "id"], "left_anti").drop("has_quality", "has_companion")


def renumbered(rows: DataFrame, key: list[str], *order: Column | str, to: str = "order") -> DataFrame:
    """Order 1 to n within the key."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def neighbours(rows: DataFrame, key: list[str], order: str, id_col: str) -> DataFrame:
    """Previous and next id and the 0-based index; at the ends a row is its own neighbour."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumns({
        "index": F.row_number().over(w) - 1,
        "previous": F.coalesce(F.lag(id_col).over(w), F.col(id_col)),
        "next": F.coalesce(F.lead(id_col).over(w), F.col(id_col)),
    })


def in_order(rows: DataFrame, key: list[str], order: str, id_col: str) -> DataFrame:
    """(key, ids): the ids of each key in ascending order, ties by id."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(id_col).alias("i"))))
    return rows.groupBy(*key).agg(F.transform(listed, lambda x: x["i"]).alias("ids"))


def siblings(rows: DataFrame, order: str, id_col: str, key: list[str]) -> DataFrame:
    """Previous and next paper within a catalogue (key); null at the ends."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumns({"previous": F.lag(id_col).over(w), "next": F.lead(id_col).over(w)})


def ends(rows: DataFrame, key: list[str], order: str, id_col: str) -> DataFrame:
    """First and last id of each key."""
    return rows.groupBy(*key).agg(F.min_by(id_col, order).alias("first_id"), F.max_by(id_col, order).alias("last_id"))


def merged_children(segments: DataFrame) -> DataFrame:
    """(paper_id, target, child, order) of passages merged into another; headings are left out."""
    return segments.filter(F.col("mergedIntoSegmentId").isNotNull() & ~F.coalesce(F.col("kind") == "heading", F.lit(False))).select("paper_id", F.col("mergedIntoSegmentId").alias("target"), F.col("id").alias("child"), "order")


def forward(segments: DataFrame, shown: Column, key: list[str], order: str, id_col: str) -> DataFrame:
    """For each row the first shown id at or after it, else the last shown one: an as-of lookup as one window pass."""
    # From the end, so that the frame grows row by row: frames that end with the partition are computed anew for every row.
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    after = F.last(F.when(shown, F.col(id_col)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.first(F.when(shown, F.col(id_col)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return segments.withColumn("resolved", F.coalesce(after, last))


def resolve(wanted: DataFrame, segments: DataFrame, shown: DataFrame, exhibits: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, wanted, resolved): the visible segment that an id leads to. First hit of: the id itself; what it was
    merged into; the first visible high-confidence segment of the exhibit it captions (companion papers); the first
    visible one at or after its order; the last visible one. Unknown ids lead to the first visible segment."""
    here = shown.select("paper_id", F.col("id").alias("v"), F.lit(True).alias("is_shown"))
    known = segments.select("paper_id", "id", "order", "mergedIntoSegmentId")
    known = known.join(here.select("paper_id", F.col("v").alias("id"), F.col("is_shown").alias("shown_self")), ["paper_id", "id"], "left")
    known = known.join(here.select("paper_id", F.col("v").alias("mergedIntoSegmentId"), F.col("is_shown").alias("shown_target")), ["paper_id", "mergedIntoSegmentId"], "left")
    known = forward(known, F.col("shown_self"), ["paper_id"], "order", "id")
    # The first exhibit of a caption, then that exhibit's first link to a visible segment.
    captions = exhibits.groupBy("paper_id", F.col("captionSegmentId").alias("caption")).agg(F.min_by(F.struct("id", "position"), "position").alias("e")).filter("caption is not null")
    target = (
        links.filter(F.col("confidence") == "high").join(here.select("paper_id", F.col("v").alias("segmentId")), ["paper_id", "segmentId"], "left_semi")
        .groupBy("paper_id", "exhibitId").agg(F.min_by("segmentId", "position").alias("segmentId"))
    )
    led = captions.join(papers.filter("has_companion"), "paper_id", "left_semi").join(target.withColumnRenamed("exhibitId", "eid"), (captions.paper_id == target.paper_id) & (F.col("e.id") == F.col("eid")), "left").select(captions.paper_id, "caption", F.col("e.position").alias("at"), F.col("segmentId").alias("led"))
    a, b = led.select("paper_id", F.col("caption").alias("id"), F.struct("at", "led").alias("a")), led.select("paper_id", F.col("caption").alias("mergedIntoSegmentId"), F.struct("at", "led").alias("b"))
    known = known.join(a, ["paper_id", "id"], "left").join(b, ["paper_id", "mergedIntoSegmentId"], "left")
    sooner = F.when(F.col("a").isNull() | (F.col("b.at") < F.col("a.at")), F.col("b.led")).otherwise(F.col("a.led"))
    known = known.select(
        "paper_id", F.col("id").alias("wanted"),
        F.coalesce(F.when(F.col("shown_self"), F.col("id")), F.when(F.col("shown_target"), F.col("mergedIntoSegmentId")), sooner, F.col("resolved")).alias("found"),
    )
    first = shown.groupBy("paper_id").agg(F.min_by("id", "order").alias("first_id"))
    return wanted.join(known, ["paper_id", "wanted"], "left").join(first, "paper_id", "left").select("paper_id", "wanted", F.coalesce("found", "first_id").alias("resolved"))


def pages(fragments: str = "fragments") -> Column:
    """Distinct pages of a segment in first-seen order, joined by the ideographic comma."""
    return F.array_join(F.array_distinct(F.transform(F.col(fragments), lambda f: f["page"].cast("string"))), "、")


def distinct_fragments(fragments: str = "fragments") -> Column:
    return F.array_distinct(F.transform(F.col(fragments), lambda f: F.struct(f["page"].alias("page"), f["bbox"].alias("bbox"))))


def regions(has_companion: Column, inline: Column) -> Column:
    """Boxes to show for a segment: its exhibits' where it has any, without companion and unless inline exhibits stand in
    body text; else its fragments'. Needs columns exhibits (array of structs), fragments and kind."""
    box = lambda r: F.struct(r["page"].alias("page"), r["bbox"].alias("bbox"), r["pageSize"].alias("pageSize"))
    own = (F.size("exhibits") > 0) & ~F.coalesce(has_companion, F.lit(False)) & ~(F.coalesce(inline, F.lit(False)) & (F.col("kind") == "body"))
    return F.when(own, F.transform("exhibits", box)).otherwise(F.transform("fragments", box))


def reading_list(shown: DataFrame) -> DataFrame:
    """Position as three digits, whether the segment is a fragment, and its text."""
    from glossa.functions.text import padded

    numbered = renumbered(shown, ["paper_id"], "order", to="position")
    return numbered.select("paper_id", padded("position", 3).alias("label"), F.coalesce(F.col("paragraphAssessment.status") == "fragment", F.lit(False)).alias("is_fragment"), "sourceText")


def navigated(shown: DataFrame, wanted: DataFrame) -> DataFrame:
    """(paperId, order, segmentId) for each (paper_id, position) that is wanted and exists."""
    own = renumbered(shown, ["paper_id"], "order", to="position").withColumn("position", F.col("position").cast("long"))
    asked = wanted.select("paper_id", F.col("position").cast("long").alias("position"))
    return own.join(asked, ["paper_id", "position"]).select(F.col("paper_id").alias("paperId"), F.col("position").alias("order"), F.col("id").alias("segmentId"))


def navigate(shown: DataFrame, paper_id: str, order: int) -> DataFrame:
    """(paperId, order, segmentId) of the order-th visible segment; no row where it doesn't exist."""
    if order < 1:
        raise ValueError("order starts at 1")
    own = renumbered(shown.filter(F.col("paper_id") == paper_id), ["paper_id"], "order", to="position")
    return own.filter(F.col("position") == order).select(F.col("paper_id").alias("paperId"), F.col("position").alias("order"), F.col("id").alias("segmentId"))
