"""Local edits merged with newly published data.

stored and source are segment tables with paper_id, id and order. A null field means that the row doesn't have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.text import is_caption_sentence
from glossa.operators.segments import renumbered
from glossa.session import shared_folder

_DONE = ("reviewed", "published")


def order_repair(stored: DataFrame, source: DataFrame, previous: DataFrame) -> DataFrame:
    """(paper_id, id, order, origin): the reading order after a repair. previous: (paper_id, previous_ids), for the papers
    whose repair is new. Where the stored ids are exactly the previous ones, the source's sequence holds; otherwise every
    source segment that is neither stored nor previous goes before the first stored segment that comes later in the
    source, or to the end. One window gives that anchor; nothing is inserted one by one."""
    ids = stored.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "id"))), lambda x: x["id"]).alias("stored_ids"))
    flags = previous.join(ids, "paper_id").select("paper_id", "previous_ids", F.col("stored_ids").eqNullSafe(F.col("previous_ids")).alias("same"))
    place = stored.select("paper_id", "id", F.col("order").alias("at"))
    joined = source.select("paper_id", "id", F.col("order").alias("source_order")).join(place, ["paper_id", "id"], "left").join(flags, "paper_id", "left")
    later = Window.partitionBy("paper_id").orderBy(F.desc("source_order")).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("anchor", F.min("at").over(later))
    same, repaired = F.coalesce("same", F.lit(False)), F.col("previous_ids").isNotNull()
    replaced = joined.filter(same).select("paper_id", "id", F.struct(F.col("source_order").cast("double").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("k"), F.when(F.col("at").isNull(), "source").otherwise("stored").alias("origin"))
    new = joined.filter(repaired & ~same & F.col("at").isNull() & ~F.array_contains("previous_ids", F.col("id"))).select(
        "paper_id", "id", F.struct(F.coalesce(F.col("anchor").cast("double"), F.lit(float("inf"))).alias("a"), F.lit(0).alias("b"), F.col("source_order").alias("c")).alias("k"), F.lit("source").alias("origin")
    )
    kept = stored.join(flags.select("paper_id", "same"), "paper_id", "left").filter(~F.coalesce("same", F.lit(False))).select("paper_id", "id", F.struct(F.col("order").cast("double").alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c")).alias("k"), F.lit("stored").alias("origin"))
    return renumbered(replaced.unionByName(new).unionByName(kept), ["paper_id"], "k").drop("k")


def unit_repairs(stored: DataFrame, source: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies repairs (paper_id, position, targetId, previousSegments, absorbedIds) in list order; returns the segments
    and (paper_id, id, status pending | protected).

    A repair sees the effects of earlier ones, but only through the segments that both touch. So all repairs run together
    that no earlier one shares a segment with, then those that waited for them, and so on: as many rounds as the longest
    chain of repairs over shared segments, each a few joins over the touched segments only. Whole papers are never gathered,
    and segments that no repair touches pass by."""
    spark, names, key = stored.sparkSession, stored.columns, ["paper_id", "id"]
    fresh = source.select(*(F.col(c) if c in source.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in names))
    none = F.array().cast("array<string>")
    listed = repairs.select("paper_id", "position", "targetId", "previousSegments", F.coalesce("absorbedIds", none).alias("absorbedIds"))
    of_repair = F.array_compact(F.concat(F.array("targetId"), "absorbedIds", F.coalesce(F.transform("previousSegments", lambda p: p["id"]), none)))
    path = shared_folder(spark)

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    left = written(listed.withColumn("__ids", F.array_distinct(of_repair)), "repairs")
    ids = left.select("paper_id", F.explode("__ids").alias("id")).distinct()
    own, versions, marks, k = stored.join(ids, key, "left_semi"), fresh.join(ids, key, "left_semi"), [], 0
    while True:
        k += 1
        touching = left.select("paper_id", "position", F.explode("__ids").alias("id"))
        earliest = touching.groupBy("paper_id", "id").agg(F.min("position").alias("earliest"))
        waiting = written(touching.join(earliest, key).filter("position > earliest").select("paper_id", "position").distinct(), f"waiting-{k}")
        last = not waiting.count()
        if not last and k == 1:
            own, versions = written(own, "own"), written(versions, "fresh")
        ready = left if last else left.join(waiting, ["paper_id", "position"], "left_anti")
        own, marked = _repaired(own, versions, ready, names)
        if last:
            marks.append(marked)
            break
        own = written(own, f"own-{k}")
        marks.append(written(marked, f"marks-{k}"))
        left = written(left.join(waiting, ["paper_id", "position"], "left_semi"), f"left-{k}")
    nothing = spark.createDataFrame([], T.StructType([stored.schema["paper_id"], T.StructField("id", T.StringType()), T.StructField("status", T.StringType())]))
    return stored.join(ids, key, "left_anti").unionByName(own), reduce(DataFrame.unionByName, marks, nothing)


def _repaired(own: DataFrame, versions: DataFrame, repairs: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: repairs that share no segment. The touched segments afterwards, and the marks."""
    one = ["paper_id", "position"]
    alike = lambda a, b, fields: F.array_min(F.array(*(F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in fields)))
    whole = lambda rows, name: rows.select("paper_id", F.col("id").alias("targetId"), F.struct(*names).alias(name))
    met = repairs.join(whole(own, "target"), ["paper_id", "targetId"]).join(whole(versions, "fresh"), ["paper_id", "targetId"])
    before = repairs.select(*one, F.explode("previousSegments").alias("before"))
    now = own.select("paper_id", F.struct(*names).alias("now"), F.col("id").alias("__id"))
    open_ = ~F.coalesce(F.col("now.reviewStatus").isin(*_DONE), F.lit(False))
    held = before.withColumn("__id", F.col("before.id")).join(now, ["paper_id", "__id"], "left")
    held = held.withColumn("held", F.coalesce(F.col("now").isNotNull() & alike("now", "before", ("sourceText", "fragments", "translation")) & open_, F.lit(False)))
    # A segment that stands several times is untouched if one of them is.
    untouched = held.groupBy(*one, "__id", "before").agg(F.max("held").alias("held")).groupBy(*one).agg(F.min("held").alias("untouched"))
    met = met.join(untouched, one, "left").withColumns({"untouched": F.coalesce("untouched", F.lit(True)), "already": alike("target", "fresh", ("sourceText", "fragments"))})
    met = met.withColumn("blocked", ~F.col("already") & ~F.col("untouched"))
    done = met.filter("not blocked")
    put = done.filter("not already").select("paper_id", F.col("targetId").alias("id"), F.col("fresh").alias("__fresh"))
    into = done.select("paper_id", "targetId", F.explode("absorbedIds").alias("id")).groupBy("paper_id", "id").agg(F.first("targetId").alias("__into"))
    rows = own.join(put, ["paper_id", "id"], "left").join(into, ["paper_id", "id"], "left")
    value = {c: F.when(F.col("__fresh").isNotNull(), F.col(f"__fresh.{c}")).otherwise(F.col(c)) for c in names}
    absorbed = F.col("__fresh").isNull() & F.col("__into").isNotNull()
    value["excluded"] = F.when(F.col("__fresh").isNotNull(), F.coalesce("excluded", "__fresh.excluded")).when(absorbed, F.coalesce("excluded", F.lit(True))).otherwise(F.col("excluded"))
    value["mergedIntoSegmentId"] = F.when(absorbed, F.col("__into")).otherwise(value["mergedIntoSegmentId"])
    mark = lambda ids, status: F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(status).alias("status")))
    marks = met.filter("blocked").select("paper_id", F.explode(F.concat(mark(F.array("targetId"), "pending"), mark("absorbedIds", "protected"))).alias("m")).select("paper_id", "m.*")
    return rows.select(*(value[c].alias(c) for c in names)), marks


def field_merge(stored: DataFrame, source: DataFrame, protected: DataFrame | None = None, explained: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Merges the fields of stored rows with their source rows, column by column. protected: (paper_id, id) whose excluded
    and merged fields keep their absence. explained: (paper_id, id, sourceText, previousTranslation). sections: (paper_id,
    id, sourceText, previousSection, section)."""
    key = ["paper_id", "id"]
    rows = stored.alias("t").join(source.select(*key, *(F.col(c).alias(f"n_{c}") for c in source.columns if c not in key)).withColumn("has_source", F.lit(True)), key, "left")
    rows = rows.join(protected.select(*key).distinct().withColumn("is_protected", F.lit(True)), key, "left") if protected is not None else rows.withColumn("is_protected", F.lit(False))
    same = F.coalesce(F.col("n_sourceText") == F.col("sourceText"), F.lit(False))
    boxes = F.coalesce(F.col("n_fragments") == F.col("fragments"), F.lit(False)) if "fragments" in stored.columns else F.lit(True)
    open_ = ~F.coalesce("is_protected", F.lit(False))
    draft = ~F.coalesce(F.col("reviewStatus").isin(*_DONE), F.lit(False)) if "reviewStatus" in stored.columns else F.lit(True)
    new: dict[str, Column] = {}
    role = same & F.col("readingRole").isNull() if "readingRole" in stored.columns else F.lit(False)
    section = F.col("section") if "section" in stored.columns else None
    if "readingRole" in stored.columns:
        if section is not None:
            section = F.when(role & F.col("n_readingRole").isNotNull() & (F.col("n_readingRole") != ""), F.col("n_section")).otherwise(section)
        new["readingRole"] = F.when(role, F.col("n_readingRole")).otherwise(F.col("readingRole"))
    if sections is not None and section is not None:
        rows = rows.join(sections.select(*key, F.col("sourceText").alias("r_text"), F.col("previousSection").alias("r_previous"), F.col("section").alias("r_section")), key, "left")
        fits = (F.col("sourceText") == F.col("r_text")) & (F.col("n_section") == F.col("r_section")) & (F.col("section") == F.col("r_previous")) & boxes & draft
        if "translation" in stored.columns:
            fits = fits & ~F.coalesce(F.col("translation.status") == "reviewed", F.lit(False))
        section = F.when(F.coalesce(fits, F.lit(False)), F.col("r_section")).otherwise(section)
    if section is not None:
        new["section"] = section
    if explained is not None:
        rows = rows.join(explained.select(*key, F.col("sourceText").alias("e_text"), F.col("previousTranslation").alias("e_previous")), key, "left")
        fits = (F.col("sourceText") == F.col("e_text")) & F.col("translation").eqNullSafe(F.col("e_previous")) & draft
        new["translation"] = F.when(F.coalesce(fits, F.lit(False)), F.col("n_translation")).otherwise(F.col("translation"))
    if "excluded" in stored.columns:
        new["excluded"] = F.when(open_ & F.col("excluded").isNull() & same, F.col("n_excluded")).otherwise(F.col("excluded"))
    if "mergedIntoSegmentId" in stored.columns:
        new["mergedIntoSegmentId"] = F.when(open_ & F.col("mergedIntoSegmentId").isNull() & same, F.col("n_mergedIntoSegmentId")).otherwise(F.col("mergedIntoSegmentId"))
    if "exhibitIds" in stored.columns:
        new["exhibitIds"] = F.coalesce("n_exhibitIds", "exhibitIds")
    if "exhibitMentions" in stored.columns:
        new["exhibitMentions"] = F.when(same & boxes, F.col("n_exhibitMentions"))
    if "kind" in stored.columns:
        moved = same & (F.col("kind") == "caption") & (F.col("n_kind") == "body") & is_caption_sentence("sourceText") & draft
        new["kind"] = F.when(F.coalesce(moved, F.lit(False)), "body").otherwise(F.col("kind"))
    if "paragraphAssessment" in stored.columns:
        new["paragraphAssessment"] = F.when(same, F.col("n_paragraphAssessment"))
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in stored.columns))


#: Fields of a document that are the published ones whatever was stored.
SOURCE_FIELDS = ["exhibits", "references", "citations", "readingOrderRepair", "inlineExhibitsEnabled", "exhibitCompanion", "readingUnitRepairs", "sectionRepairs"]


def current_quality(rows: DataFrame, segments: DataFrame, id_col: str = "segmentId") -> DataFrame:
    """Appendices or repairs whose segment still exists; related ids that are gone are taken out."""
    have = segments.select("paper_id", F.col("id"))
    kept = rows.join(have.withColumnRenamed("id", id_col), ["paper_id", id_col], "left_semi")
    if "relatedSegmentIds" not in rows.columns:
        return kept
    alive = kept.select("paper_id", id_col, F.posexplode("relatedSegmentIds").alias("k", "id")).join(have, ["paper_id", "id"], "left_semi").groupBy("paper_id", id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("alive"))
    return kept.join(alive, ["paper_id", id_col], "left").withColumn("relatedSegmentIds", F.coalesce("alive", F.array().cast("array<string>"))).drop("alive")


def reconcile(stored: DataFrame, source: DataFrame, *, broken: DataFrame | None = None, previous: DataFrame | None = None, repairs: DataFrame | None = None, explained: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """All steps in their order: reading order, unit repairs, fields, numbering. Papers without stored segments, and those
    in broken (paper_id) whose stored document failed validation, come out as published."""
    own = stored if broken is None else stored.join(broken.select("paper_id"), "paper_id", "left_anti")
    protected = None
    if previous is not None:
        order = order_repair(own, source, previous)
        names = own.columns
        kept = own.drop("order").join(order.filter("origin = 'stored'").select("paper_id", "id", "order"), ["paper_id", "id"]).select(*names)
        new = source.drop("order").join(order.filter("origin = 'source'").select("paper_id", "id", "order"), ["paper_id", "id"]).select(*names)
        # A replaced order drops stored segments that the source no longer has.
        own = kept.unionByName(new)
    if repairs is not None:
        own, marks = unit_repairs(own, source, repairs)
        protected = marks.filter("status = 'protected'")
    merged = field_merge(own, source, protected, explained, sections)
    untouched = source.join(own.select("paper_id").distinct(), "paper_id", "left_anti").select(*own.columns)
    return renumbered(merged.unionByName(untouched), ["paper_id"], "order")


def reconcile_documents(stored: DataFrame, source: DataFrame, stored_segments: DataFrame, source_segments: DataFrame, **steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the fields that the published version owns, and their reconciled segments (steps as for reconcile).
    Papers in broken come out as published, as do those that were never stored."""
    fields = [f for f in SOURCE_FIELDS if f in source.columns and f in stored.columns]
    own = stored if steps.get("broken") is None else stored.join(steps["broken"].select("paper_id"), "paper_id", "left_anti")
    # One join instead of a union of what is stored and what isn't: Spark zips the partitions of a union whose sides are both
    # dealt by paper, and fails where they were coalesced to different numbers.
    names = [c for c in stored.columns if c != "paper_id"]
    held = own.select("paper_id", *(F.col(c).alias(f"t_{c}") for c in names), F.lit(True).alias("is_stored"))
    value = lambda c: F.col(c) if c in fields else F.when(F.col("is_stored"), F.col(f"t_{c}")).otherwise(F.col(c))
    documents = source.join(held, "paper_id", "left").select(*(F.col(c) if c == "paper_id" else value(c).alias(c) for c in stored.columns))
    return documents, reconcile(stored_segments, source_segments, **steps)
