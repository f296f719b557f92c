"""Study pages: the normalised record, its parts as rows, and the rendered HTML, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import filled, html_escape, script_json, script_safe, trim_plain
from glossa.operators.quality import InvalidInput, colour, require, trimmed
from glossa.operators.quality import study_page as checked

# Tokens of the page template and the field or value that replaces each.
TOKENS = {
    "__PAGE_TITLE__": "page_title",
    "__DOCUMENT_TITLE__": "title",
    "__DOCUMENT_SUBTITLE__": "subtitle",
    "__SOURCE_NOTE__": "source_note",
    "__MERMAID_SOURCE_JSON__": "mermaid",
    "__NODE_DETAILS_JSON__": "node_details",
    "__STATISTICS_JSON__": "statistics",
    "__GLOSSARY_JSON__": "glossary",
    "__DISCUSSIONS_JSON__": "discussions",
    "__EASY_READ_JSON__": "easy_read",
}
# Wording of the published pages.
NO_STATISTICS, NO_GLOSSARY = "本文未報告可整理的量化統計方法。", "本文沒有需要另外解釋的特殊縮寫或專門名詞。"


def _record(x: Column, fields: list[str]) -> Column:
    return F.struct(*((colour(x[f]) if f == "color" else trim_plain(x[f])).alias(f) for f in fields))


def _blocks(bs: Column) -> Column:
    return F.transform(bs, lambda b: F.struct(b["type"].alias("type"), trim_plain(b["text"]).alias("text"), trimmed(b["items"]).alias("items"), trimmed(b["headers"]).alias("headers"), F.transform(b["rows"], trimmed).alias("rows")))


def normalised(pages: DataFrame, *more: Column) -> DataFrame:
    """Known fields only, trimmed, colours in capitals; and what else is asked for."""
    each = lambda name, fields: F.transform(name, lambda x: _record(x, fields)).alias(name)
    nodes = F.transform_values("node_details", lambda _, n: _record(n, ["title", "summary", "explanation", "page", "color"])).alias("node_details")
    discussions = F.transform("discussions", lambda d: F.struct(trim_plain(d["title"]).alias("title"), trim_plain(d["question"]).alias("question"), _blocks(d["blocks"]).alias("blocks"), trim_plain(d["page"]).alias("page"))).alias("discussions")
    sections = F.transform(F.col("easy_read.sections"), lambda s: F.struct(trim_plain(s["title"]).alias("title"), _blocks(s["blocks"]).alias("blocks")))
    return pages.select(
        *(trim_plain(c).alias(c) for c in ("page_title", "title", "subtitle", "source_note", "mermaid")), nodes, each("statistics", ["name", "label", "meaning", "reason", "caution", "color"]),
        each("glossary", ["term", "full_name", "explanation", "page", "color"]), discussions, F.struct(trim_plain("easy_read.intro").alias("intro"), sections.alias("sections")).alias("easy_read"), *more,
    )


def _block_json(b: Column) -> Column:
    """A block with the fields of its type only."""
    text = F.to_json(F.struct(b["type"].alias("type"), b["text"].alias("text")))
    items = F.to_json(F.struct(b["type"].alias("type"), b["items"].alias("items")))
    table = F.to_json(F.struct(b["type"].alias("type"), b["headers"].alias("headers"), b["rows"].alias("rows")))
    return F.when(b["type"].isin("bullets", "numbered"), items).when(b["type"] == "table", table).otherwise(text)


def _json(name: str) -> Column:
    listed = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    blocks = lambda bs: listed(F.transform(bs, _block_json))
    if name == "mermaid":
        return script_safe(quoted(F.col("mermaid")))
    if name == "discussions":
        one = lambda d: F.concat(F.lit('{"title":'), quoted(d["title"]), F.lit(',"question":'), quoted(d["question"]), F.lit(',"blocks":'), blocks(d["blocks"]), F.lit(',"page":'), quoted(d["page"]), F.lit("}"))
        return script_safe(listed(F.transform("discussions", one)))
    if name == "easy_read":
        one = lambda s: F.concat(F.lit('{"title":'), quoted(s["title"]), F.lit(',"blocks":'), blocks(s["blocks"]), F.lit("}"))
        return script_safe(F.concat(F.lit('{"intro":'), quoted(F.col("easy_read.intro")), F.lit(',"sections":'), listed(F.transform("easy_read.sections", one)), F.lit("}")))
    return script_json(name)


def render(pages: DataFrame, template: str) -> DataFrame:
    """Pages with `html`, judged in the same pass: reading the html of an invalid page raises with the rule that it breaks.
    The template is a small text read once on the driver."""
    missing = [t for t in TOKENS if t not in template]
    if missing:
        raise InvalidInput(f"the template lacks {missing[0]}")
    judged = checked(pages)
    rows = normalised(judged, F.col("error"))
    html = F.lit(template)
    for token, name in TOKENS.items():
        value = html_escape(name) if name in ("page_title", "title", "subtitle", "source_note") else _json(name)
        html = F.replace(html, F.lit(token), value)
    return rows.withColumn("html", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("invalid study page: "), "error"))).otherwise(html)).drop("error")


def rendered_ok(html: Column) -> Column:
    left = F.lit(False)
    for token in TOKENS:
        left = left | F.contains(html, F.lit(token))
    return ~left & F.contains(F.lower(F.substring(html, 1, 100)), F.lit("<!doctype html>")) & F.contains(F.lower(html), F.lit("</html>"))


def summary(pages: DataFrame) -> DataFrame:
    return pages.select(F.size("node_details").alias("nodes"), F.size("statistics").alias("statistics"), F.size("glossary").alias("glossary"), F.size("discussions").alias("discussions"), F.size("easy_read.sections").alias("easy_sections"))


def contents(pages: DataFrame, key: str = "title") -> DataFrame:
    return pages.select(F.col(key).alias("page"), F.posexplode("easy_read.sections").alias("k", "s")).select("page", F.concat(F.lit("easy-read-"), F.col("k") + 1).alias("anchor"), F.col("s.title").alias("title"))


def outline(pages: DataFrame, key: str = "title") -> DataFrame:
    rows = pages.select(F.col(key).alias("page"), F.posexplode(F.map_entries("node_details")).alias("k", "e"))
    return rows.select("page", "k", F.concat("e.value.title", F.lit("（"), "e.value.page", F.lit("）")).alias("line"))


def block_html(b: Column) -> Column:
    tag = lambda name, x, kind="": F.concat(F.lit(f"<{name}{kind}>"), x, F.lit(f"</{name}>"))
    many = lambda xs, name: F.array_join(F.transform(xs, lambda x: tag(name, html_escape(x))), "")
    rows = F.array_join(F.transform(b["rows"], lambda r: tag("tr", many(r, "td"))), "")
    table = tag("table", F.concat(tag("thead", tag("tr", many(b["headers"], "th"))), tag("tbody", rows)))
    return (
        F.when(b["type"] == "paragraph", tag("p", html_escape(b["text"]))).when(b["type"] == "subheading", tag("h3", html_escape(b["text"]))).when(b["type"] == "note", tag("p", html_escape(b["text"]), ' class="note"'))
        .when(b["type"] == "bullets", tag("ul", many(b["items"], "li"))).when(b["type"] == "numbered", tag("ol", many(b["items"], "li"))).when(b["type"] == "table", table)
    )


def blocks_html(bs: Column) -> Column:
    return F.array_join(F.transform(bs, block_html), "")


def statistic_cards(pages: DataFrame, key: str = "title") -> DataFrame:
    """A card per statistic, empty labels and cautions as null; a page without statistics gives one placeholder card."""
    rows = pages.select(F.col(key).alias("page"), F.posexplode_outer("statistics").alias("k", "s"))
    return rows.select("page", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("s.name", F.lit(NO_STATISTICS)).alias("name"), filled("s.label").alias("label"), "s.meaning", "s.reason", filled("s.caution").alias("caution"), F.col("s").isNull().alias("is_placeholder"))


def glossary_cards(pages: DataFrame, key: str = "title") -> DataFrame:
    rows = pages.select(F.col(key).alias("page"), F.posexplode_outer("glossary").alias("k", "g"))
    return rows.select("page", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("g.term", F.lit(NO_GLOSSARY)).alias("term"), "g.full_name", "g.explanation", F.col("g.page").alias("at"), F.col("g").isNull().alias("is_placeholder"))


def discussion_cards(pages: DataFrame, key: str = "title") -> DataFrame:
    rows = pages.select(F.col(key).alias("page"), F.posexplode("discussions").alias("k", "d"))
    return rows.select("page", (F.col("k") + 1).alias("number"), "d.title", "d.question", blocks_html(F.col("d.blocks")).alias("html"), F.col("d.page").alias("at"))


def _runs(tokens: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), "-"))


def node_of_element(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(element_id, node_id): the longest node id that stands in an element id between dashes or ends, else the element's
    data id if it is a node. elements: (element_id, data_id); nodes: (node_id). What stands between dashes is taken apart,
    and only stretches of as many parts as some node id has are looked up, by equality: an id costs its parts times those
    few sizes."""
    known = nodes.select("node_id").distinct()
    sizes = sorted(r.n for r in known.select(F.size(F.split("node_id", "-")).alias("n")).distinct().collect())
    tokens = F.split("element_id", "-")
    starts = lambda n: F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    runs = [_runs(tokens, starts(n), n) for n in sizes]
    named = elements.select("element_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *runs))).alias("node_id"), F.lit(1).alias("in_id"))
    named = named.unionByName(elements.filter("data_id is not null").select("element_id", F.col("data_id").alias("node_id"), F.lit(0).alias("in_id")))
    best = named.join(known, "node_id").groupBy("element_id").agg(F.max_by("node_id", F.struct("in_id", F.length("node_id").alias("size"), "node_id")).alias("node_id"))
    return elements.select("element_id").distinct().join(best, "element_id", "left")
