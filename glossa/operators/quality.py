"""Validation as columns: every rule is computed for every row, and the first failing rule by priority is named.

The functions add `error` (the name of the first broken rule, or null); nothing is raised while a plan runs. Callers that
want an exception use require().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import casefold, is_blank, trim_plain

# States, docks, block types and limits of the documented formats.
TRANSLATION_STATES = ("untranslated", "ai-draft", "reviewed")
DOCKS = ("translation", "source", "floating")
BLOCK_TYPES = ("paragraph", "subheading", "note", "bullets", "numbered", "table")
LAYOUT_LIMITS = {"width": (280, 1600), "height": (180, 1400), "mobileHeight": (140, 800), "x": (-10000, 10000), "y": (-10000, 10000)}
ZOOM_LIMITS = (0.5, 4.0)
COLOUR, NODE_ID = r"^#[0-9A-Fa-f]{6}$", r"^[A-Za-z][A-Za-z0-9_-]*$"
TEXT_LIMIT, BACKUP_BYTES = 20_000, 1024 * 1024


class InvalidInput(ValueError):
    """Rows that break a rule."""


def first_error(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose column isn't true."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules), F.lit(None).cast("string"))


def require(rows: DataFrame) -> DataFrame:
    """Raises with the first broken rule, else returns the rows without their error column."""
    bad = rows.filter("error is not null").select("error").first()
    if bad:
        raise InvalidInput(bad.error)
    return rows.drop("error")


def text_ok(x: Column, most: int = TEXT_LIMIT, allow_empty: bool = False) -> Column:
    n = F.length(trim_plain(x))
    return x.isNotNull() & (n <= most) & (F.lit(True) if allow_empty else n > 0)


def colour_ok(x: Column) -> Column:
    return F.coalesce(x.rlike(COLOUR), F.lit(False))


def colour(x: Column) -> Column:
    return F.when(colour_ok(x), F.upper(x))


def strings_ok(xs: Column, least: int | Column = 1, most: int | Column = 100) -> Column:
    return xs.isNotNull() & F.size(xs).between(least, most) & F.forall(xs, lambda x: x.isNotNull() & (F.length(trim_plain(x)) > 0) & (F.length(x) <= TEXT_LIMIT))


def trimmed(xs: Column) -> Column:
    return F.transform(xs, trim_plain)


def block_ok(b: Column) -> Column:
    text = b["type"].isin("paragraph", "subheading", "note") & text_ok(b["text"])
    items = b["type"].isin("bullets", "numbered") & strings_ok(b["items"])
    width = F.size(b["headers"])
    table = (b["type"] == "table") & strings_ok(b["headers"], 2, 12) & b["rows"].isNotNull() & F.size(b["rows"]).between(1, 200) & F.forall(b["rows"], lambda r: strings_ok(r, width, width))
    return F.coalesce(text, F.lit(False)) | F.coalesce(items, F.lit(False)) | F.coalesce(table, F.lit(False))


def blocks_ok(bs: Column) -> Column:
    return bs.isNotNull() & F.size(bs).between(1, 100) & F.forall(bs, block_ok)


def html_name_ok(name: Column) -> Column:
    return F.lower(name).rlike(r"\.html?$")


def node_declared(diagram: Column, node_id: Column) -> Column:
    return F.regexp_like(diagram, F.concat(F.lit("(?<![A-Za-z0-9_-])\\Q"), node_id, F.lit("\\E(?=\\s*[\\[({])")))


def study_page(pages: DataFrame) -> DataFrame:
    """Study pages with `error`: required texts and their limits, the diagram, node details, statistics, glossary (terms
    differ even after case folding), discussions and the easy-read part."""
    c = F.col
    all_ok = lambda xs, f: xs.isNotNull() & F.forall(xs, lambda x: F.coalesce(f(x), F.lit(False)))
    first_line = F.lower(F.trim(F.regexp_extract(trim_plain(c("mermaid")), r"^([^\r\n]*)", 1)))
    nodes, ids = F.map_values("node_details"), F.map_keys("node_details")
    rows = pages.withColumn("__terms", casefold(F.array_join(F.transform("glossary", lambda g: F.coalesce(trim_plain(g["term"]), F.lit(""))), "\u0000")))
    folded = F.split("__terms", "\u0000")
    rules = [
        ("page_title", text_ok(c("page_title"), 300)), ("title", text_ok(c("title"), 500)), ("subtitle", text_ok(c("subtitle"), 1_000)),
        ("source_note", text_ok(c("source_note"), 2_000)), ("mermaid", text_ok(c("mermaid"), 200_000)),
        ("mermaid.declaration", first_line.startswith("flowchart ") | first_line.startswith("graph ")), ("mermaid.directive", ~c("mermaid").rlike(r"%%\s*\{")),
        ("node_details", c("node_details").isNotNull() & (F.size("node_details") > 0)), ("node_details.id", all_ok(ids, lambda i: i.rlike(NODE_ID))),
        ("node_details.declaration", all_ok(ids, lambda i: node_declared(c("mermaid"), i))),
        ("node_details.fields", all_ok(nodes, lambda n: text_ok(n["title"], 300) & text_ok(n["summary"], 2_000) & text_ok(n["explanation"]) & text_ok(n["page"], 500) & colour_ok(n["color"]))),
        ("statistics", c("statistics").isNotNull() & (F.size("statistics") <= 50)),
        ("statistics.fields", all_ok(c("statistics"), lambda s: text_ok(s["name"], 300) & text_ok(s["label"], 100, True) & text_ok(s["meaning"], 4_000) & text_ok(s["reason"], 4_000) & text_ok(s["caution"], 4_000, True) & colour_ok(s["color"]))),
        ("glossary", c("glossary").isNotNull() & (F.size("glossary") <= 100)),
        ("glossary.fields", all_ok(c("glossary"), lambda g: text_ok(g["term"], 100) & text_ok(g["full_name"], 500) & text_ok(g["explanation"], 8_000) & text_ok(g["page"], 500) & colour_ok(g["color"]))),
        ("glossary.duplicate", (F.size("glossary") == 0) | (F.size(F.array_distinct(folded)) == F.size(folded))),
        ("discussions", c("discussions").isNotNull() & F.size("discussions").between(4, 5)),
        ("discussions.fields", all_ok(c("discussions"), lambda d: text_ok(d["title"], 500) & text_ok(d["question"], 4_000) & blocks_ok(d["blocks"]) & text_ok(d["page"], 500))),
        ("easy_read", text_ok(c("easy_read.intro"), 8_000) & c("easy_read.sections").isNotNull() & F.size("easy_read.sections").between(1, 50)),
        ("easy_read.fields", all_ok(c("easy_read.sections"), lambda s: text_ok(s["title"], 500) & blocks_ok(s["blocks"]))),
    ]
    return rows.withColumn("error", first_error(rules)).drop("__terms")


def fragment_ok(f: Column, page_count: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    b, s = f["bbox"], f["pageSize"]
    shape = (F.size(b) == 4) & F.forall(b, finite) & (F.size(s) == 2) & F.forall(s, finite)
    at = lambda a, k: F.try_element_at(a, F.lit(k))
    inside = (at(b, 1) >= 0) & (at(b, 2) >= 0) & (at(b, 3) > at(b, 1)) & (at(b, 4) > at(b, 2)) & (at(b, 3) <= at(s, 1)) & (at(b, 4) <= at(s, 2))
    return f["page"].between(1, page_count) & shape & inside


def curated_document(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Edited documents with `error`, judged against the published ones (paper id, schema version, hash, page count)."""
    now = source.select(F.col("id").alias("n_id"), F.col("schemaVersion").alias("n_version"), F.col("sourceSha256").alias("n_sha"), F.col("pageCount").alias("n_pages"))
    rows = stored.join(now, F.col("id") == F.col("n_id"), "left")
    segs, ids = F.col("segments"), F.transform("segments", lambda s: s["id"])
    every = lambda f: F.forall(segs, lambda s: F.coalesce(f(s), F.lit(False)))
    rules = [
        ("identity", F.col("n_id").isNotNull() & F.col("schemaVersion").eqNullSafe(F.col("n_version")) & F.col("sourceSha256").eqNullSafe(F.col("n_sha"))),
        ("segments", segs.isNotNull() & (F.size(segs) > 0)), ("segments.included", F.exists(segs, lambda s: ~F.coalesce(s["excluded"], F.lit(False)))),
        ("segment.id", every(lambda s: ~is_blank(s["id"])) & (F.size(F.array_distinct(ids)) == F.size(ids))), ("segment.text", every(lambda s: ~is_blank(s["sourceText"]))),
        ("segment.fragments", every(lambda s: s["fragments"].isNotNull() & (F.size(s["fragments"]) > 0) & F.forall(s["fragments"], lambda f: F.coalesce(fragment_ok(f, F.col("n_pages")), F.lit(False))))),
        ("segment.translation", every(lambda s: s["translation"].isNotNull() & s["translation"]["status"].isin(*TRANSLATION_STATES))),
        ("segment.reviewed", every(lambda s: (s["translation"]["status"] != "reviewed") | (~is_blank(s["translation"]["faithfulZh"]) & ~is_blank(s["translation"]["plainZh"])))),
    ]
    return rows.withColumn("error", first_error(rules)).drop("n_id", "n_version", "n_sha", "n_pages")


def companion_state(states: DataFrame, documents: DataFrame) -> DataFrame:
    """Companion settings with `error`. documents: (paper_id, sourceSha256, segment_ids, exhibit_ids)."""
    now = documents.select(F.col("paper_id").alias("n_id"), F.col("sourceSha256").alias("n_sha"), "segment_ids", "exhibit_ids")
    rows = states.join(now, F.col("paperId") == F.col("n_id"), "left")
    layout = F.col("layout")
    sizes = F.lit(True)
    for name, (low, high) in LAYOUT_LIMITS.items():
        sizes = sizes & layout[name].isNotNull() & ~F.isnan(layout[name]) & layout[name].between(low, high)
    known = lambda keys, ids: F.size(F.array_except(keys, F.coalesce(F.col(ids), F.array().cast("array<string>")))) == 0
    inner = F.map_values("corrections")
    rules = [
        ("identity", (F.col("version") == 1) & F.col("n_id").isNotNull() & F.col("sourceSha256").eqNullSafe(F.col("n_sha"))), ("layout.dock", layout["dock"].isin(*DOCKS)), ("layout.size", sizes),
        ("zooms", known(F.map_keys("zooms"), "exhibit_ids") & F.forall(F.map_values("zooms"), lambda z: F.coalesce(z.between(*ZOOM_LIMITS), F.lit(False)))),
        ("corrections.segment", known(F.map_keys("corrections"), "segment_ids")), ("corrections.exhibit", known(F.flatten(F.transform(inner, F.map_keys)), "exhibit_ids")),
        ("corrections.action", F.forall(F.flatten(F.transform(inner, F.map_values)), lambda a: F.coalesce(a.isin("include", "exclude"), F.lit(False)))),
    ]
    return rows.withColumn("error", first_error(rules)).drop("n_id", "n_sha", "segment_ids", "exhibit_ids")


# Abbreviations that belong together, and the wording of the warnings.
TERM_PAPER = r"(?i)computational thinking\s*\(CT\)"
TERM_CLASH = r"(?i)CT\s*[（(]\s*(?:可能是)?(?:認知訓練|認知彈性)|(?:認知訓練|認知彈性|執行功能)\s*[（(]\s*CT|運算思維\s*[（(]\s*EF"
STALE_WARNING = "原文或白話稿與本次核對版本不同；保留本機修改，需重新核對後再作段落解釋。"
TERM_WARNING = "術語不一致：本篇 CT 是運算思維，EF 是執行功能；認知彈性是 EF 的構面。"


def explanation_warnings(segments: DataFrame, repairs: DataFrame) -> DataFrame:
    """Segments with `warnings`, for papers with quality data: a repair (paper_id, id, sourceText, plainZh) that no longer
    fits, and confused abbreviations in papers that define them. Reviewed segments have none."""
    defines = F.max(F.coalesce(F.col("sourceText").rlike(TERM_PAPER), F.lit(False))).over(Window.partitionBy("paper_id"))
    rows = segments.withColumn("__terms", defines | (F.col("paper_id") == "paper-01"))
    rows = rows.join(repairs.select("paper_id", "id", F.col("sourceText").alias("__t"), F.col("plainZh").alias("__p"), F.lit(True).alias("__r")), ["paper_id", "id"], "left")
    plain = F.col("translation.plainZh")
    stale = F.col("__r") & (~F.col("sourceText").eqNullSafe(F.col("__t")) | ~plain.eqNullSafe(F.col("__p")))
    clash = F.col("__terms") & plain.rlike(TERM_CLASH)
    said = F.array_compact(F.array(F.when(stale, STALE_WARNING), F.when(clash, TERM_WARNING)))
    return rows.withColumn("warnings", F.when(F.coalesce(F.col("translation.status") == "reviewed", F.lit(False)), F.array().cast("array<string>")).otherwise(said)).drop("__terms", "__t", "__p", "__r")
