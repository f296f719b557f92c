"""Struct types of the corpus' logical tables. Absent and null are one thing here: a field that a file lacks is null."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


_FRAGMENT = "page int, bbox array<double>, pageSize array<double>"
_TRANSLATION = "faithfulZh string, plainZh string, status string, reviewedAt string, generatedAt string, generatedBy string"
_SEGMENT = (
    "id string, `order` int, section string, kind string, sourceText string, confidence double, reviewStatus string, excluded boolean, "
    f"mergedIntoSegmentId string, readingRole string, exhibitIds array<string>, fragments array<struct<{_FRAGMENT.replace(' ', ':').replace(',:', ',')}>>, "
    "exhibitMentions array<struct<exhibitId:string,label:string,page:int,bbox:array<double>>>, "
    "paragraphAssessment struct<status:string,reasons:array<string>,relatedSegmentIds:array<string>>, "
    f"translation struct<{_TRANSLATION.replace(' ', ':').replace(',:', ',')}>"
)


def fragment() -> T.StructType:
    return _struct(_FRAGMENT)


def segment() -> T.StructType:
    return _struct(_SEGMENT)


def exhibit() -> T.StructType:
    return _struct(
        "id string, kind string, number string, label string, page int, pageSize array<double>, bbox array<double>, imageUrl string, "
        "caption string, captionZh string, captionSegmentId string, explanationSegmentIds array<string>"
    )


def link() -> T.StructType:
    return _struct("segmentId string, exhibitId string, method string, confidence string, relationshipZh string, evidenceQuote string, sourceSegmentIds array<string>, sourceTextSha256 string")


def citation() -> T.StructType:
    return _struct("id string, segmentId string, label string, sourceContext string, referenceIds array<string>, matchStatus string, relationshipZh string")


def reference() -> T.StructType:
    out = _struct("id string, label string, title string, authors string, year string, doi string, printedDoi string, doiResolution string, identityStatus string, sourceText string")
    out = out.add("fragments", T.ArrayType(fragment()))
    return out.add("abstract", _struct("status string, sourceType string, sourceUrl string, abstractOrigin string, originalText string, faithfulZh string, summaryZh string, summaryMethod string, checkedAt string, retrievalReason string"))


def repair() -> T.StructType:
    previous = _struct("id string, sourceText string").add("fragments", T.ArrayType(fragment())).add("translation", _struct(_TRANSLATION))
    return T.StructType().add("targetId", "string").add("previousSegments", T.ArrayType(previous)).add("absorbedIds", T.ArrayType(T.StringType()))


def paper_document() -> T.StructType:
    strings, out = T.ArrayType(T.StringType()), T.StructType()
    for name in ("id", "title", "schemaVersion", "sourceSha256", "sourceFileName", "pdfUrl", "publicationStatus", "generatedAt"):
        out = out.add(name, "string")
    out = out.add("pageCount", T.IntegerType()).add("inlineExhibitsEnabled", "boolean")
    out = out.add("segments", T.ArrayType(segment())).add("exhibits", T.ArrayType(exhibit())).add("citations", T.ArrayType(citation())).add("references", T.ArrayType(reference()))
    study = T.StructType().add("summaryZh", "string").add("guideZh", strings).add("limitsZh", strings)
    out = out.add("exhibitCompanion", T.StructType().add("links", T.ArrayType(link())).add("studies", T.MapType(T.StringType(), study)))
    explained = _struct("segmentId string, sourceText string").add("previousTranslation", _struct(_TRANSLATION)).add("translation", _struct(_TRANSLATION))
    appendix = _struct("segmentId string, faithfulZh string").add("exhibit", exhibit()).add("guideZh", strings).add("relatedSegmentIds", strings)
    out = out.add("readingQuality", T.StructType().add("explanationRepairs", T.ArrayType(explained)).add("appendices", T.ArrayType(appendix)))
    out = out.add("readingOrderRepair", T.StructType().add("revision", "string").add("previousSegmentIds", strings))
    out = out.add("readingUnitRepairs", T.ArrayType(repair())).add("sectionRepairs", T.ArrayType(_struct("segmentId string, sourceText string, previousSection string, section string")))
    return out.add("pendingReadingUnitRepairs", strings)


def reader_state() -> T.StructType:
    out = _struct("version int, paperId string, sourceSha256 string, currentSegmentId string, seen array<string>, understood array<string>, bookmarks array<string>, notes map<string,string>")
    return out.add("dimOpacity", "double").add("reducedMotion", "boolean").add("highContrast", "boolean").add("updatedAt", "string")


def companion_state() -> T.StructType:
    out = _struct("version int, paperId string, sourceSha256 string")
    out = out.add("layout", _struct("dock string, width double, height double, x double, y double, mobileHeight double"))
    return out.add("zooms", T.MapType(T.StringType(), T.DoubleType())).add("corrections", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))


def catalogue() -> T.StructType:
    paper = _struct(
        "id string, number int, title string, year int, pageCount int, segmentCount int, publicationStatus string, dataUrl string, pdfUrl string, "
        "sourceSha256 string, includedSegmentCount int, bodySegmentCount int, exhibitCount int"
    )
    return _struct("schemaVersion string, generatedAt string, paperCount int").add("papers", T.ArrayType(paper))


def crop_manifest() -> T.StructType:
    figure = _struct(
        "label string, page int, bbox array<double>, output string, dpi int, method string, status string, quality_score double, quality_reasons array<string>, "
        "kind string, number string, caption string, column_layout string, spans_columns boolean, referenced_in_body int, suggested_tier string"
    )
    return _struct("paperId string, sourceSha256 string, source string, kind string, dpi int, pages int").add("figures", T.ArrayType(figure))


def study_page() -> T.StructType:
    strings = T.ArrayType(T.StringType())
    block = _struct("type string, text string").add("items", strings).add("headers", strings).add("rows", T.ArrayType(strings))
    out = _struct("page_title string, title string, subtitle string, source_note string, mermaid string")
    out = out.add("node_details", T.MapType(T.StringType(), _struct("title string, summary string, explanation string, page string, color string")))
    out = out.add("statistics", T.ArrayType(_struct("name string, label string, meaning string, reason string, caution string, color string")))
    out = out.add("glossary", T.ArrayType(_struct("term string, full_name string, explanation string, page string, color string")))
    out = out.add("discussions", T.ArrayType(T.StructType().add("title", "string").add("question", "string").add("blocks", T.ArrayType(block)).add("page", "string")))
    section = T.StructType().add("title", "string").add("blocks", T.ArrayType(block))
    return out.add("easy_read", T.StructType().add("intro", "string").add("sections", T.ArrayType(section)))
