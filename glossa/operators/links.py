"""Links between segments, exhibits, citations and references, and how readers' corrections change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Wording of the published pages.
CONFIRMED = "你已確認將此語意候選加入本段伴讀；這是本機人工關聯，不代表作者明確引用。原候選依據："
ADDED = "你已將這張圖表加入本段伴讀；此關聯為本機人工選擇，不代表作者明確引用。"


def effective_corrections(corrections: DataFrame, segments: DataFrame) -> DataFrame:
    """(paper_id, segment_id, exhibit_id, action, own): corrections of segments merged into a segment apply to it in
    segment order, its own come last; the latest wins. corrections: (paper_id, segment_id, exhibit_id, action)."""
    merged = segments.select("paper_id", F.col("id").alias("segment_id"), "mergedIntoSegmentId", "order")
    rows = corrections.join(merged, ["paper_id", "segment_id"], "inner")
    ranked = rows.select("paper_id", F.col("mergedIntoSegmentId").alias("segment_id"), "exhibit_id", "action", F.struct(F.lit(0).alias("own"), "order").alias("rank")).filter("segment_id is not null")
    ranked = ranked.unionByName(rows.select("paper_id", "segment_id", "exhibit_id", "action", F.struct(F.lit(1).alias("own"), "order").alias("rank")))
    return ranked.groupBy("paper_id", "segment_id", "exhibit_id").agg(F.max_by("action", "rank").alias("action"), (F.max("rank.own") == 1).alias("own"))


def valid_links(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links whose quoted evidence is still the segment's text."""
    texts = segments.select("paper_id", F.col("id").alias("segmentId"), F.col("sourceText").alias("evidenceQuote"))
    return links.join(texts, ["paper_id", "segmentId", "evidenceQuote"], "left_semi")


def corrected(links: DataFrame, corrections: DataFrame) -> DataFrame:
    """Adds status (accepted, candidate or null) and the upgrade of kept candidates. corrections: effective ones."""
    c = corrections.select("paper_id", F.col("segment_id").alias("segmentId"), F.col("exhibit_id").alias("exhibitId"), "action")
    rows = links.join(c, ["paper_id", "segmentId", "exhibitId"], "left")
    kept = ~F.coalesce(F.col("action") == "exclude", F.lit(False)) & ((F.col("confidence") == "high") | F.coalesce(F.col("action") == "include", F.lit(False)))
    candidate = (F.col("confidence") == "candidate") & F.col("action").isNull()
    upgraded = kept & (F.col("confidence") == "candidate")
    return rows.withColumns({
        "status": F.when(kept, "accepted").when(candidate, "candidate"),
        "relationshipZh": F.when(upgraded, F.concat(F.lit(CONFIRMED), F.coalesce("relationshipZh", F.lit("")))).otherwise(F.col("relationshipZh")),
        "confidence": F.when(upgraded, "high").otherwise(F.col("confidence")),
    })


def resolve_links(links: DataFrame, corrections: DataFrame, segments: DataFrame, exhibits: DataFrame) -> DataFrame:
    """Accepted and candidate links of every segment. An included exhibit without a kept link gives a link of its own,
    where the exhibit exists."""
    rows = corrected(valid_links(links, segments), corrections)
    have = rows.filter("status = 'accepted'").select("paper_id", F.col("segmentId").alias("segment_id"), F.col("exhibitId").alias("exhibit_id"))
    added = (
        corrections.filter("action = 'include'").join(have, ["paper_id", "segment_id", "exhibit_id"], "left_anti")
        .join(exhibits.select("paper_id", F.col("id").alias("exhibit_id")), ["paper_id", "exhibit_id"], "left_semi")
        .join(segments.select("paper_id", F.col("id").alias("segment_id"), "sourceText"), ["paper_id", "segment_id"])
        .select(
            "paper_id", F.col("segment_id").alias("segmentId"), F.col("exhibit_id").alias("exhibitId"), F.lit("semantic").alias("method"), F.lit("high").alias("confidence"),
            F.lit(ADDED).alias("relationshipZh"), F.col("sourceText").alias("evidenceQuote"), F.array("segment_id").alias("sourceSegmentIds"), F.lit("").alias("sourceTextSha256"), F.lit("accepted").alias("status"),
        )
    )
    return rows.filter("status is not null").drop("action").unionByName(added, allowMissingColumns=True)


def exhibit_overview(resolved: DataFrame, shown: DataFrame, own_corrections: DataFrame) -> DataFrame:
    """(paper_id, exhibit_id, segment_id, order, label): visible segments that accept an exhibit. The label says `added`
    where the segment's own correction includes it, else the link's method."""
    own = own_corrections.filter("action = 'include'").select("paper_id", F.col("segment_id").alias("segmentId"), F.col("exhibit_id").alias("exhibitId"), F.lit(True).alias("added"))
    at = shown.select("paper_id", F.col("id").alias("segmentId"), "order")
    rows = resolved.filter("status = 'accepted'").join(at, ["paper_id", "segmentId"]).join(own, ["paper_id", "segmentId", "exhibitId"], "left")
    explicit = F.max(F.when(F.col("method") == "explicit", 1).otherwise(0)) == 1
    label = F.when(F.coalesce(F.max(F.col("added").cast("int")) == 1, F.lit(False)), "added").when(explicit, "explicit").otherwise("semantic")
    return rows.groupBy("paper_id", F.col("exhibitId").alias("exhibit_id"), F.col("segmentId").alias("segment_id"), "order").agg(label.alias("label"))


def segment_exhibits(segments: DataFrame, exhibits: DataFrame, key: str = "paper_id") -> DataFrame:
    """One row per listed exhibit that exists, with its place in the list."""
    rows = segments.select(key, "id", F.posexplode("exhibitIds").alias("position", "exhibitId"))
    return rows.join(exhibits.withColumnRenamed("id", "exhibitId"), [key, "exhibitId"])


def exhibit_by_id(rows: DataFrame, id_col: str, exhibits: DataFrame) -> DataFrame:
    """Rows with the exhibit that a column names, as a struct; null if there is none."""
    own = exhibits.select("paper_id", F.col("id").alias(id_col), F.struct(*(c for c in exhibits.columns if c != "paper_id")).alias("exhibit"))
    return rows.join(own, ["paper_id", id_col], "left")


def linked_flags(exhibits: DataFrame, links: DataFrame) -> DataFrame:
    """Exhibits with whether any high-confidence link points at them."""
    high = links.filter("confidence = 'high'").select("paper_id", F.col("exhibitId").alias("id"), F.lit(True).alias("__linked")).distinct()
    return exhibits.join(high, ["paper_id", "id"], "left").withColumn("is_linked", F.coalesce("__linked", F.lit(False))).drop("__linked")


def selected_exhibit(chosen: Column, accepted_ids: Column) -> Column:
    return F.coalesce(chosen, F.try_element_at(accepted_ids, F.lit(1)))


def accepted_or_selected(exhibits: DataFrame, accepted: DataFrame, selected: str | None) -> DataFrame:
    """Exhibits accepted for a segment, or the one that is open."""
    ids = accepted.select("paper_id", F.col("exhibitId").alias("id")).distinct()
    rows = exhibits.join(ids.withColumn("__a", F.lit(True)), ["paper_id", "id"], "left")
    return rows.filter(F.coalesce("__a", F.lit(False)) | F.coalesce(F.col("id") == F.lit(selected), F.lit(False))).drop("__a")


def valid_citations(citations: DataFrame, segments: DataFrame) -> DataFrame:
    """Citations whose context still stands in their segment; the segment id is the join key, so nothing is crossed."""
    texts = segments.select("paper_id", F.col("id").alias("segmentId"), "sourceText")
    return citations.join(texts, ["paper_id", "segmentId"]).filter(F.contains("sourceText", "sourceContext")).drop("sourceText")


def matched_citations(citations: DataFrame) -> DataFrame:
    """One row per reference of a matched citation."""
    return citations.filter("matchStatus = 'matched'").select("*", F.explode(F.array_distinct("referenceIds")).alias("reference_id"))


def citing_segments(matched: DataFrame, segments: DataFrame) -> DataFrame:
    """(paper_id, reference_id, segment_id, order): distinct citing segments that exist and aren't excluded."""
    at = segments.filter(~F.coalesce("excluded", F.lit(False))).select("paper_id", F.col("id").alias("segmentId"), "order")
    return matched.select("paper_id", "reference_id", "segmentId").distinct().join(at, ["paper_id", "segmentId"]).withColumnRenamed("segmentId", "segment_id")


def chosen_reference(status: Column, ids: Column) -> Column:
    return F.when(status == "matched", F.try_element_at(ids, F.lit(1)))


def mentioned_exhibits(texts: DataFrame, text_col: str, exhibits: DataFrame, key: str = "paper_id") -> DataFrame:
    """Mentions in a text joined to the first exhibit of their kind and number; unmatched mentions drop out."""
    from glossa.functions.text import mentions

    said = texts.withColumn("m", F.explode(mentions(text_col))).select(*texts.columns, F.col("m.text").alias("mention"), F.col("m.kind").alias("kind"), F.col("m.number").alias("number"))
    w = Window.partitionBy(key, "kind", "number").orderBy("position")
    first = exhibits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, "kind", "number", F.col("id").alias("exhibit_id"))
    return said.join(first, [key, "kind", "number"])


def guide_versions(papers: DataFrame, audit: DataFrame) -> DataFrame:
    """Papers with the audited hash of their guide, or `local`."""
    return papers.join(audit.select("paper_id", "sha256"), "paper_id", "left").withColumn("version", F.coalesce("sha256", F.lit("local"))).drop("sha256")


def existing_related(rows: DataFrame, ids_col: str, segments: DataFrame, keep_excluded: bool = True) -> DataFrame:
    """One row per related segment id that exists (and, on request, isn't excluded)."""
    at = segments if keep_excluded else segments.filter(~F.coalesce("excluded", F.lit(False)))
    return rows.withColumn("related", F.explode(F.array_distinct(ids_col))).join(at.select("paper_id", F.col("id").alias("related")), ["paper_id", "related"], "left_semi")


def explanations(exhibits: DataFrame, segments: DataFrame) -> DataFrame:
    """(paper_id, exhibit_id, segment_id): explaining segments that exist, aren't excluded and aren't fragments."""
    ok = segments.filter(~F.coalesce("excluded", F.lit(False)) & ~F.coalesce(F.col("paragraphAssessment.status") == "fragment", F.lit(False)))
    rows = exhibits.select("paper_id", F.col("id").alias("exhibit_id"), F.posexplode("explanationSegmentIds").alias("position", "segment_id"))
    return rows.join(ok.select("paper_id", F.col("id").alias("segment_id")), ["paper_id", "segment_id"])


def exhibit_role(segment_id: Column, caption_id: Column, explanation_ids: Column) -> Column:
    return F.struct(F.coalesce(segment_id == caption_id, F.lit(False)).alias("is_caption"), F.coalesce(F.array_contains(explanation_ids, segment_id), F.lit(False)).alias("is_explanation"))


def labelled_links(resolved: DataFrame, exhibits: DataFrame) -> DataFrame:
    """Links with their exhibit's label: accepted ones need the exhibit, candidates may lack it."""
    rows = resolved.join(exhibits.select("paper_id", F.col("id").alias("exhibitId"), F.col("label").alias("exhibit_label")), ["paper_id", "exhibitId"], "left")
    return rows.filter("status = 'candidate' or exhibit_label is not null")


def routed_papers(routes: DataFrame, papers: DataFrame) -> DataFrame:
    """Routes (id) with whether they lead to a paper; unknown ids lead to the library."""
    return routes.join(papers.select(F.col("paper_id").alias("id"), F.lit(True).alias("__known")), "id", "left").withColumn("view", F.when(F.col("__known"), "paper").otherwise("library")).drop("__known")


def mentions_on_page(segments: DataFrame, page: int) -> DataFrame:
    return segments.select("*", F.explode("exhibitMentions").alias("mention")).filter(F.col("mention.page") == page)


def caption_remains(segments: DataFrame, captions: DataFrame, state: DataFrame) -> DataFrame:
    """Segments merged into a caption that carry a note or bookmark. captions: (paper_id, caption); state: (paper_id,
    segment_id)."""
    rows = segments.join(captions.withColumnRenamed("caption", "mergedIntoSegmentId"), ["paper_id", "mergedIntoSegmentId"], "left_semi")
    return rows.join(state.withColumnRenamed("segment_id", "id"), ["paper_id", "id"], "left_semi")
