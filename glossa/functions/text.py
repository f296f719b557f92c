"""Text functions as column expressions (JVM side); the few that Spark has no function for are Arrow UDFs, named so."""

from __future__ import annotations

import re
import unicodedata
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from pyspark.sql._typing import ColumnOrName

# Fixed value: mention pattern as published. Groups: Latin name, Chinese name, number.
MENTION = r"(?i)(?:\b(Table|Tables|Fig(?:ure)?s?\.?)|([表圖]))\s*(\d+)(?!\d)"
# Fixed value: sentences that start like a caption but are running text.
CAPTION_SENTENCE = r"(?i)^(?:Table\s+\d+|Fig(?:ure)?\.?\s+\d+)\s+(?:shows|displays|presents|illustrates|represents|depicts)\b"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# White space as browsers and as Python see it (the space separators, and what else each of them trims).
_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\t\n\v\f\r"
SCRIPT_SPACES, PLAIN_SPACES = _SEPARATORS + "\ufeff", _SEPARATORS + "\x1c\x1d\x1e\x1f\x85"


def trim_script(x: ColumnOrName) -> Column:
    """Trims what a browser trims: Unicode white space and the byte-order mark. Only the ends of a text are looked at."""
    return F.btrim(_c(x), F.lit(SCRIPT_SPACES))


def trim_plain(x: ColumnOrName) -> Column:
    """Trims what Python trims: Unicode white space, the next-line sign and the separators U+001C to U+001F."""
    return F.btrim(_c(x), F.lit(PLAIN_SPACES))


def is_blank(x: ColumnOrName) -> Column:
    return F.coalesce(F.length(trim_script(x)) == 0, F.lit(True))


def filled(x: ColumnOrName) -> Column:
    """The text, or null where it is empty: for chains in which an empty text counts as missing."""
    return F.nullif(_c(x), F.lit(""))


def html_escape(x: ColumnOrName) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def script_safe(json: ColumnOrName) -> Column:
    """JSON text that may stand inside a script element."""
    out = _c(json)
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def script_json(x: ColumnOrName) -> Column:
    """A struct, map or array as script-safe JSON with explicit nulls."""
    return script_safe(F.to_json(_c(x), {"ignoreNullFields": "false"}))


def strip_abstract(x: ColumnOrName) -> Column:
    return F.regexp_replace(_c(x), r"(?i)^Abstract\s+", "")


def mentions(x: ColumnOrName) -> Column:
    """array<struct<text, kind, number>> of the tables and figures that a text mentions, in order."""
    whole, latin, chinese, number = (F.regexp_extract_all(_c(x), F.lit(MENTION), F.lit(k)) for k in range(4))
    zipped = F.arrays_zip(whole, latin, chinese, number)

    def one(m: Column) -> Column:
        table = (m["2"] == "表") | F.lower(m["1"]).startswith("table")
        return F.struct(m["0"].alias("text"), F.when(table, "table").otherwise("figure").alias("kind"), m["3"].alias("number"))

    return F.transform(zipped, one)


def is_caption_sentence(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x).rlike(CAPTION_SENTENCE), F.lit(False))


def padded(x: ColumnOrName, width: int) -> Column:
    """Zero-padded on the left; longer values stay whole."""
    text = _c(x).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def date_part(x: ColumnOrName) -> Column:
    return F.substring(_c(x), 1, 10)


def storage_key(prefix: str, paper_id: ColumnOrName) -> Column:
    return F.concat(F.lit(prefix), _c(paper_id))


def regex_quoted(x: ColumnOrName) -> Column:
    """A pattern that matches exactly this text."""
    return F.concat(F.lit("\\Q"), F.replace(_c(x), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def https_url(x: ColumnOrName) -> Column:
    """The URL if it parses and its scheme is https, else null. The input's spelling is kept."""
    return F.when(F.lower(F.try_parse_url(_c(x), F.lit("PROTOCOL"))) == "https", _c(x))


def deployed_url(x: ColumnOrName, base: str) -> Column:
    """Absolute paths move below the base path; //host and relative addresses stay."""
    url = _c(x)
    return F.when(url.startswith("/") & ~url.startswith("//"), F.concat(F.lit(base.rstrip("/")), url)).otherwise(url)


def route(x: ColumnOrName) -> Column:
    """struct<mode, id> of a hash route: edit:ID, guide:ID or ID; the old form paper=NN means the guide of paper-NN."""
    hashless = F.regexp_replace(_c(x), r"^#", "")
    old = F.regexp_extract(hashless, r"^paper=(\d+)$", 1)
    kind = F.regexp_extract(hashless, r"^(edit|guide):", 1)
    return F.when(
        old != "", F.struct(F.lit("guide").alias("mode"), F.concat(F.lit("paper-"), F.when(F.length(old) < 2, F.lpad(old, 2, "0")).otherwise(old)).alias("id"))
    ).otherwise(F.struct(F.when(kind != "", kind).when(hashless == "", "library").otherwise("reader").alias("mode"), F.regexp_replace(hashless, r"^(edit|guide):", "").alias("id")))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


_MENTION_TYPE = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("kind", T.StringType()).add("number", T.StringType())
_OUTSIDE = re.compile("[^a-zA-Z0-9一-鿿]+")


def slug_of(text: str | None) -> str:
    name = _OUTSIDE.sub("-", unicodedata.normalize("NFKD", text or "")).strip("-")[:72]
    return name or "paper-notes"


@F.pandas_udf(T.StringType())
def slug(s: pd.Series) -> pd.Series:
    return s.map(slug_of)


@F.pandas_udf(T.ArrayType(_MENTION_TYPE))
def mention_offsets(s: pd.Series) -> pd.Series:
    """Mentions with their places in the text (code points)."""
    pattern = re.compile(MENTION)

    def of(text):
        if text is None:
            return None
        return [{"start": m.start(), "end": m.end(), "kind": "table" if m[2] == "表" or (m[1] or "").lower().startswith("table") else "figure", "number": m[3]} for m in pattern.finditer(text)]

    return s.map(of)
