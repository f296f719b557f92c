"""Labels and fallbacks of records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import filled, is_blank

# Wording of the published pages.
TRANSLATION_LABELS = {"reviewed": "人工校訂", "ai-draft": "AI 草稿"}
UNTRANSLATED_LABEL = "待翻譯"
ABSTRACT_LABELS = {
    "crossref": "出版社提交的 Crossref 摘要紀錄",
    "author": "作者機構官方文獻頁的 Abstract",
    "openalex": "OpenAlex 資料庫收錄的摘要（非 AI 研究總結）",
    "semantic-scholar": "Semantic Scholar 資料庫的 Abstract 欄位（未使用 TLDR 或 AI 總結）",
    "europe-pmc": "Europe PMC 資料庫收錄的原始 Abstract",
    "openaire": "OpenAIRE 收錄的來源機構摘要／描述欄位（非本工具生成的總結）",
    "doaj": "DOAJ 開放取用期刊資料庫收錄的 Abstract",
    "ebsco": "EBSCO 公開紀錄的 Abstract 欄位（編撰者未標明，非本工具生成的總結）",
}
ERIC_LABELS = {"ERIC": "ERIC 資料庫編撰的文獻摘要（非作者原始 Abstract）", "As Provided": "ERIC 收錄、由出版社或作者提供的 Abstract"}
ERIC_OTHER_LABEL = "ERIC 資料庫收錄的文獻摘要（編撰者未標明）"
ABSTRACT_OTHER_LABEL = "出版社文獻頁的 Abstract"


def _cases(key: Column, labels: dict[str, str], other: Column | str) -> Column:
    out = F
    for k, v in labels.items():
        out = out.when(key == k, v)
    return out.otherwise(other)


def translation_label(status: Column) -> Column:
    return _cases(status, TRANSLATION_LABELS, UNTRANSLATED_LABEL)


def abstract_label(source_type: Column, origin: Column) -> Column:
    eric = _cases(origin, ERIC_LABELS, ERIC_OTHER_LABEL)
    return F.when(source_type == "eric", eric).otherwise(_cases(source_type, ABSTRACT_LABELS, ABSTRACT_OTHER_LABEL))


def translation_status(faithful: Column, plain: Column) -> Column:
    return F.when(is_blank(faithful) & is_blank(plain), "untranslated").otherwise("ai-draft")


def relationship(own: Column, assessment: Column, context: Column, plain: Column, faithful: Column) -> Column:
    """What relates a citation to its segment; an empty text counts as missing at every step."""
    rest = F.when(assessment == "fragment", context).otherwise(F.coalesce(filled(plain), filled(faithful), context))
    return F.coalesce(filled(own), rest)


def segment_count(body: Column, included: Column, total: Column) -> Column:
    return F.coalesce(body, included, total)


def doi_notice(resolution: Column, printed: Column, doi: Column) -> Column:
    """`conflict` where a resolved DOI differs from the printed one, `resolved` where it was added, else null."""
    return F.when(filled(resolution).isNotNull(), F.when(filled(printed).isNotNull() & ~printed.eqNullSafe(doi), "conflict").otherwise("resolved"))


def abstract_usable(identity_status: Column) -> Column:
    return ~F.coalesce(identity_status == "title-mismatch", F.lit(False))
