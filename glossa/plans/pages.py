"""Named queries of sources, sinks and study pages, each through the operator that it is named for, with the SQL that gives the
same rows. What is written goes to the application's shared folder and is read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators import quality, study
from glossa.plans import views as V
from glossa.plans.corpus import query
from glossa.session import shared_folder
from glossa.sources import corpus_json, sinks
from glossa.streaming import responses
from glossa.streaming import state as streamed

# Study pages: one for every part.

_DIAGRAM = "flowchart LR\n A1[x] --> B2(y)"


def _pages(spark, d, broken=False):
    """Pages of parts; broken: nine of ten break a rule."""
    p, name = F.col("p_partkey"), F.col("p_name")
    k = F.when(F.lit(broken), p % 10).otherwise(F.lit(0).cast("long"))
    text = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"), none.alias("items"), none.alias("headers"), rows.alias("rows"))
    none, rows = F.lit(None).cast("array<string>"), F.lit(None).cast("array<array<string>>")
    bullets = F.struct(F.lit("bullets").alias("type"), F.lit(None).cast("string").alias("text"), F.array(F.lit(" a "), F.lit("<b>")).alias("items"), none.alias("headers"), rows.alias("rows"))
    cells = F.array(F.array(F.lit("1"), F.lit("2")))
    table = F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), none.alias("items"), F.when(k == 9, F.array(F.lit("h"), F.lit("i"), F.lit("j"))).otherwise(F.array(F.lit("h"), F.lit("i"))).alias("headers"), cells.alias("rows"))
    node = F.struct(F.concat(name, F.lit(" ")).alias("title"), F.lit("s").alias("summary"), F.lit("e").alias("explanation"), p.cast("string").alias("page"), F.lit("#abcdef").alias("color"))
    second = F.when(k == 4, "1A").when(k == 5, "ZZ").otherwise("B2")
    statistic = lambda n: F.struct(F.concat(F.lit("n"), n).alias("name"), F.when(p % 2 == 0, "").otherwise("label").alias("label"), F.lit("m").alias("meaning"), F.lit("r").alias("reason"), F.lit("").alias("caution"), F.lit("#315F91").alias("color"))
    term = lambda t: F.struct(t.alias("term"), F.lit("full").alias("full_name"), F.lit("e").alias("explanation"), F.lit("1").alias("page"), F.lit("#315F91").alias("color"))
    first = F.when(k == 8, text("poem", F.lit("x"))).otherwise(text("paragraph", F.concat(F.lit("<"), name, F.lit(">"))))
    talk = lambda n: F.struct(F.concat(F.lit("d"), n).alias("title"), F.lit("q").alias("question"), F.array(first, bullets).alias("blocks"), F.lit("2").alias("page"))
    section = lambda n: F.struct(F.concat(F.lit("one "), n).alias("title"), F.array(text("subheading", F.lit("h")), table).alias("blocks"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    glossary = F.when(k == 6, F.array(term(F.lit("Straße")), term(F.lit("STRASSE")))).otherwise(F.transform(upto(p % 2), lambda n: term(F.concat(F.lit("T"), n))))
    return V.dealt(V.table(spark, d, "part")).select(
        F.when(k == 1, " ").otherwise(F.concat(F.lit(" P & "), name)).alias("page_title"), p.cast("string").alias("title"), F.lit("S").alias("subtitle"), F.lit("N").alias("source_note"),
        F.when(k == 2, "sequence\n A1[x] B2(y)").when(k == 3, "flowchart LR\n%%{init}\n A1[x] --> B2(y)").otherwise(_DIAGRAM).alias("mermaid"), F.create_map(F.lit("A1"), node, second, node).alias("node_details"),
        F.transform(upto(p % 3), statistic).alias("statistics"), glossary.alias("glossary"), F.transform(upto(F.when(k == 7, F.lit(3).cast("long")).otherwise(p % 2 + 4)), talk).alias("discussions"),
        F.struct(F.lit("i").alias("intro"), F.transform(upto(p % 3 + 1), section).alias("sections")).alias("easy_read"),
    )


@query(
    "SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'page_title' WHEN 2 THEN 'mermaid.declaration' WHEN 3 THEN 'mermaid.directive' WHEN 4 THEN 'node_details.id' WHEN 5 THEN 'node_details.declaration' "
    "WHEN 6 THEN 'glossary.duplicate' WHEN 7 THEN 'discussions' WHEN 8 THEN 'discussions.fields' WHEN 9 THEN 'easy_read.fields' END AS error FROM part"
)
def study_errors(spark, d):
    return quality.study_page(_pages(spark, d, True)).select(F.col("title").cast("long").alias("p_partkey"), "error")


@query("SELECT CAST(2 AS INTEGER) AS nodes, p_partkey % 3 AS statistics, p_partkey % 2 AS glossary, p_partkey % 2 + 4 AS discussions, p_partkey % 3 + 1 AS easy_sections FROM part")
def study_summary(spark, d):
    got = study.summary(_pages(spark, d))
    return got.select("nodes", *(F.col(c).cast("long").alias(c) for c in ("statistics", "glossary", "discussions", "easy_sections")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS page, 'easy-read-' || n AS anchor, 'one ' || n AS title FROM (SELECT p_partkey, unnest(range(1, p_partkey % 3 + 2)) AS n FROM part)")
def study_contents(spark, d):
    return study.contents(_pages(spark, d))


@query("SELECT CAST(p_partkey AS VARCHAR) AS page, k, p_name || ' （' || p_partkey || '）' AS line FROM part, (SELECT unnest([0, 1]) AS k)")
def study_outline(spark, d):
    return study.outline(_pages(spark, d))


@query(
    "WITH x AS (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [0] ELSE range(1, p_partkey % 3 + 1) END) AS n FROM part) SELECT CAST(p_partkey AS VARCHAR) AS page, CASE WHEN n = 0 THEN '本文未報告可整理的量化統計方法。' ELSE 'n' || n END AS name, "
    "CASE WHEN n > 0 AND p_partkey % 2 = 1 THEN 'label' END AS label, CASE WHEN n > 0 THEN 'm' END AS meaning, n = 0 AS is_placeholder FROM x"
)
def study_statistics(spark, d):
    return study.statistic_cards(_pages(spark, d)).select("page", "name", "label", "meaning", "is_placeholder")


@query("SELECT CAST(p_partkey AS VARCHAR) AS page, CASE WHEN p_partkey % 2 = 1 THEN 'T1' ELSE '本文沒有需要另外解釋的特殊縮寫或專門名詞。' END AS term, CASE WHEN p_partkey % 2 = 1 THEN 'full' END AS full_name, p_partkey % 2 = 0 AS is_placeholder FROM part")
def study_glossary(spark, d):
    return study.glossary_cards(_pages(spark, d)).select("page", "term", "full_name", "is_placeholder")


@query("SELECT CAST(p_partkey AS VARCHAR) AS page, n AS number, 'd' || n AS title, 'q' AS question, '<p>&lt;' || p_name || '&gt;</p><ul><li> a </li><li>&lt;b&gt;</li></ul>' AS html, '2' AS shown_at FROM (SELECT p_partkey, p_name, unnest(range(1, p_partkey % 2 + 5)) AS n FROM part)")
def study_discussions(spark, d):
    return study.discussion_cards(_pages(spark, d)).withColumn("number", F.col("number").cast("long")).withColumnRenamed("at", "shown_at")


def _template() -> str:
    return "<!doctype html><html>" + "|".join(study.TOKENS) + "</html>"


_NODE = "'{\"title\":\"' || p_name || '\",\"summary\":\"s\",\"explanation\":\"e\",\"page\":\"' || p_partkey || '\",\"color\":\"#ABCDEF\"}'"
_LIST = "'[' || coalesce((SELECT string_agg({one}, ',' ORDER BY n) FROM (SELECT unnest(range(1, {upto} + 1)) AS n)), '') || ']'"


@query(
    "SELECT p_partkey, md5('<!doctype html><html>P &amp; ' || p_name || '|' || p_partkey || '|S|N|' || '\"flowchart LR\\n A1[x] --\\u003e B2(y)\"' || '|' || '{\"A1\":' || "
    + _NODE + " || ',\"B2\":' || " + _NODE + " || '}|' || "
    + _LIST.format(one="'{\"name\":\"n' || n || '\",\"label\":\"' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'label' END || '\",\"meaning\":\"m\",\"reason\":\"r\",\"caution\":\"\",\"color\":\"#315F91\"}'", upto="p_partkey % 3")
    + " || '|' || CASE WHEN p_partkey % 2 = 1 THEN '[{\"term\":\"T1\",\"full_name\":\"full\",\"explanation\":\"e\",\"page\":\"1\",\"color\":\"#315F91\"}]' ELSE '[]' END || '|' || "
    + _LIST.format(one="'{\"title\":\"d' || n || '\",\"question\":\"q\",\"blocks\":[{\"type\":\"paragraph\",\"text\":\"\\u003c' || p_name || '\\u003e\"},{\"type\":\"bullets\",\"items\":[\"a\",\"\\u003cb\\u003e\"]}],\"page\":\"2\"}'", upto="p_partkey % 2 + 4")
    + " || '|{\"intro\":\"i\",\"sections\":' || "
    + _LIST.format(one="'{\"title\":\"one ' || n || '\",\"blocks\":[{\"type\":\"subheading\",\"text\":\"h\"},{\"type\":\"table\",\"headers\":[\"h\",\"i\"],\"rows\":[[\"1\",\"2\"]]}]}'", upto="p_partkey % 3 + 1")
    + " || '}</html>') AS html, true AS is_sound FROM part"
)
def study_html(spark, d):
    """Pages rendered with a template that was written and read back."""
    path = shared_folder(spark)
    sinks.write_text(spark.createDataFrame([(_template(),)], "t string"), path, "t")
    html = study.render(_pages(spark, d), corpus_json.template(spark, path).rstrip("\n"))
    return html.select(F.col("title").cast("long").alias("p_partkey"), F.md5("html").alias("html"), study.rendered_ok(F.col("html")).alias("is_sound"))


@query("SELECT p_partkey, p_partkey % 3 < 2 AS is_named FROM part")
def html_names(spark, d):
    p = F.col("p_partkey")
    name = F.when(p % 3 == 0, "a.HTML").when(p % 3 == 1, "b.htm").otherwise("c.html.txt")
    return V.table(spark, d, "part").select("p_partkey", quality.html_name_ok(name).alias("is_named"))


# Sources and sinks: the nations stand for papers, of which there are few.


def _nations(spark, d):
    return V.table(spark, d, "nation")


@query("SELECT 'p' || n_nationkey AS paper_id, n_nationkey AS number, n_name AS title FROM nation")
def catalogue(spark, d):
    paper = F.struct(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("number"), F.col("n_name").alias("title"))
    whole = _nations(spark, d).agg(F.collect_list(paper).alias("papers")).select(F.struct(F.lit("1").alias("schemaVersion"), F.size("papers").alias("paperCount"), "papers").alias("c"))
    path = shared_folder(spark)
    sinks.write_text(whole.select(sinks.to_json(F.col("c")).alias("json")), path, "json")
    return corpus_json.catalogue(spark, path).select("paper_id", "number", "title")


def _documents(spark, d):
    """Nations as documents of one segment for each customer (the first ten)."""
    tr = F.struct(F.lit("f").alias("faithfulZh"), F.lit("p").alias("plainZh"), F.lit("reviewed").alias("status"))
    box = F.struct(F.lit(1).alias("page"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("bbox"), F.array(F.lit(2.0), F.lit(2.0)).alias("pageSize"))
    seg = lambda k: F.struct(F.concat(F.lit("s"), k).alias("id"), k.cast("int").alias("order"), F.concat(F.lit("text "), k).alias("sourceText"), (k % 2 == 0).alias("excluded"), F.array(box).alias("fragments"), tr.alias("translation"))
    return _nations(spark, d).select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("1").alias("schemaVersion"), F.lit("h").alias("sourceSha256"), F.lit(3).alias("pageCount"), F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 4 + 1), seg).alias("segments"))


@query("SELECT 'p' || n_nationkey AS paper_id, 's' || k AS id, k % 2 = 0 AS excluded FROM (SELECT n_nationkey, unnest(range(1, n_nationkey % 4 + 2)) AS k FROM nation)")
def exported_documents(spark, d):
    """Documents that pass validation, written as JSON, one folder each, and read back as segments."""
    docs, path = _documents(spark, d), shared_folder(spark)
    sinks.export_curated(docs, docs.select("id", "schemaVersion", "sourceSha256", "pageCount"), path)
    return corpus_json.segments(corpus_json.paper_documents(spark, f"{path}/*/*.json")).select("paper_id", "id", "excluded")


@query("SELECT 'p' || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' edited' ELSE n_name END AS title FROM nation")
def imported_documents(spark, d):
    """Every third document comes in edited, every fourth with another hash, which is refused."""
    docs = _documents(spark, d)
    number = F.substring("id", 2, 9).cast("long")
    incoming = docs.filter((number % 3 == 0) | (number % 4 == 1)).withColumns({"title": F.concat("title", F.lit(" edited")), "sourceSha256": F.when((number % 4 == 1) & (number % 3 != 0), "old").otherwise(F.col("sourceSha256"))})
    return sinks.imported_curated(docs, incoming, docs.select("id", "schemaVersion", "sourceSha256", "pageCount"))[0].select("id", "title")


@query("SELECT 'p' || n_nationkey AS paper_id, 'f' || k AS label, k AS page FROM (SELECT n_nationkey, unnest([1, 2]) AS k FROM nation)")
def crop_manifests(spark, d):
    """Manifests of every nation; those without a name of their own take their folder's."""
    figure = lambda k: F.struct(F.lit(f"f{k}").alias("label"), F.lit(k).alias("page"))
    rows = _nations(spark, d).select(F.concat(F.lit("p"), "n_nationkey").alias("folder"), F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("p"), "n_nationkey")).alias("paperId"), F.array(figure(1), figure(2)).alias("figures")).alias("m"))
    path = shared_folder(spark)
    rows.select("folder", sinks.to_json(F.col("m")).alias("value")).write.partitionBy("folder").text(path)
    got = corpus_json.crops(spark, f"{path}/*/*.txt").select(F.regexp_replace("paper_id", "^folder=", "").alias("paper_id"), "label", "page")
    return got


@query("SELECT CAST(title AS BIGINT) AS n_nationkey, 2 AS nodes FROM (SELECT n_nationkey AS title FROM nation)")
def study_page_files(spark, d):
    pages, path = _pages(spark, d), shared_folder(spark)
    few = pages.join(_nations(spark, d).select(F.col("n_nationkey").cast("string").alias("title")), "title").select(*pages.columns)
    own = _nations(spark, d).join(few, F.col("n_nationkey").cast("string") == F.col("title"), "left").select(F.col("n_nationkey").cast("string").alias("title"), F.coalesce("node_details", F.create_map(F.lit("A1"), F.lit(None).cast("struct<title:string,summary:string,explanation:string,page:string,color:string>"), F.lit("B2"), F.lit(None).cast("struct<title:string,summary:string,explanation:string,page:string,color:string>"))).alias("node_details"))
    own.select("title", sinks.to_json(F.struct("title", "node_details")).alias("value")).withColumnRenamed("title", "name").write.partitionBy("name").text(path)
    return corpus_json.study_pages(spark, f"{path}/*/*.txt").select(F.col("title").cast("long").alias("n_nationkey"), F.size("node_details").alias("nodes"))


@query(f"WITH {V.ACTIONS} SELECT user_id, count(DISTINCT k) AS seen FROM acts GROUP BY 1 UNION ALL SELECT -1, NULL")
def stored_states(spark, d):
    """Reader states written as JSON and parsed again; a broken text gives a null state."""
    states = V.actions(spark, d).groupBy("user_id").agg(F.collect_set(F.col("k").cast("string")).alias("seen")).select(F.lit(1).alias("version"), F.col("user_id").cast("string").alias("paperId"), "seen")
    path = shared_folder(spark)
    sinks.export_states(states, path)
    rows = spark.read.text(path).unionByName(spark.createDataFrame([("{broken",)], "value string"))
    got = corpus_json.parsed_states(rows, "value", "reader")
    return got.select(F.coalesce(F.col("state.paperId").cast("long"), F.lit(-1).cast("long")).alias("user_id"), F.when(F.col("state.seen").isNotNull(), F.size("state.seen").cast("long")).alias("seen"))


@query("SELECT 'p' || n_nationkey AS paper, CAST(n_nationkey / 8.0 AS DOUBLE) AS zoom FROM nation WHERE n_nationkey % 5 <> 0")
def companion_backups(spark, d):
    """Companion states as files; every fifth is over the size limit and isn't read."""
    body = F.struct(F.lit(1).alias("version"), F.concat(F.lit("p"), "n_nationkey").alias("paperId"), F.create_map(F.lit("e"), F.col("n_nationkey") / F.lit(8.0)).alias("zooms"))
    padded = F.concat(sinks.to_json(body), F.when(F.col("n_nationkey") % 5 == 0, F.repeat(F.lit(" "), quality.BACKUP_BYTES)).otherwise(""))
    path = shared_folder(spark)
    _nations(spark, d).select(F.col("n_nationkey").alias("name"), padded.alias("value")).write.partitionBy("name").text(path)
    got = corpus_json.companion_backups(spark, f"{path}/*/*.txt")
    return got.select(F.col("state.paperId").alias("paper"), F.try_element_at("state.zooms", F.lit("e")).alias("zoom"))


@query("SELECT n_nationkey AS paper_id, CASE WHEN n_nationkey % 2 = 0 THEN 'second' ELSE 'first' END AS note, true AS is_stamped FROM nation WHERE n_nationkey % 7 <> 0")
def persisted_states(spark, d):
    """States written by paper, half of them replaced, every seventh taken out when they are read."""
    rows, path = _nations(spark, d).select(F.col("n_nationkey").alias("paper_id"), F.lit("first").alias("note")), shared_folder(spark)
    sinks.persist(rows, path)
    sinks.persist(rows.filter("paper_id % 2 = 0").withColumn("note", F.lit("second")), path)
    stored = spark.read.schema("note string, updatedAt string, paper_id int").parquet(path)
    return sinks.without(stored, rows.filter("paper_id % 7 = 0").select("paper_id")).select("paper_id", "note", F.col("updatedAt").isNotNull().alias("is_stamped"))


@query("SELECT doc_id || ' ' || source AS line, true AS was_kept FROM documents")
def written_texts(spark, d):
    """Texts written once; a second write without force is refused, one with force replaces them."""
    rows, path = V.table(spark, d, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), "source").alias("line")), shared_folder(spark)
    sinks.write_text(rows.limit(1), path, "line")
    kept = False
    try:
        sinks.write_text(rows, path, "line")
    except AnalysisException:
        kept = True
    sinks.write_text(rows, path, "line", force=True)
    return spark.read.text(path).select(F.col("value").alias("line"), F.lit(kept).alias("was_kept"))


@query("SELECT CAST(doc_id AS VARCHAR) || ' v2' AS line FROM documents")
def rewritten_texts(spark, d):
    """Texts made from those that they replace: the old version is read while the new one is written beside it."""
    path = shared_folder(spark)
    sinks.write_text(V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("line")), path, "line")
    sinks.write_text(spark.read.text(path).select(F.concat("value", F.lit(" v2")).alias("line")), path, "line", force=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT n_nationkey AS name, '<p>' || n_name || '</p>' AS html FROM nation")
def html_files(spark, d):
    path = shared_folder(spark)
    sinks.write_html(_nations(spark, d).select(F.concat("n_nationkey", F.lit(".html")).alias("name"), F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("html")), path)
    got = spark.read.text(path)
    return got.select(F.regexp_replace("name", r"\.html$", "").cast("int").alias("name"), F.col("value").alias("html"))


_YES = "CASE WHEN {} THEN '是' ELSE '否' END"


@query(
    "WITH x AS (SELECT conv_id, turn, turn % 2 = 0 AS noted, turn % 3 = 0 AS marked, turn % 4 = 0 AS done FROM conversations), y AS (SELECT conv_id, turn, '## sec · 第 ' || turn || ' 頁' || chr(10) || chr(10) || '- 段落 ID：`' || turn || '`' || chr(10) || '- 書籤：' || "
    + _YES.format("marked") + " || chr(10) || '- 已理解：' || " + _YES.format("done")
    + " || chr(10) || CASE WHEN noted THEN chr(10) || 'note ' || turn || chr(10) ELSE '' END AS md FROM x WHERE noted OR marked) "
    "SELECT conv_id, md5('# title ' || conv_id || chr(10) || chr(10) || '- 來源檔案：file' || chr(10) || '- 來源 SHA-256：`sha`' || chr(10) || '- 匯出時間：now' || chr(10) || chr(10) || string_agg(md, chr(10) ORDER BY turn)) AS markdown FROM y GROUP BY 1"
)
def markdown_notes(spark, d):
    t = V.turns(spark, d)
    segs = t.select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("string").alias("id"), F.col("turn").alias("order"), F.lit("sec").alias("section"), F.array(F.struct(F.col("turn").alias("page"))).alias("fragments"))
    ids = lambda n: F.collect_list(F.when(F.col("turn") % n == 0, F.col("turn").cast("string")))
    notes = F.map_from_entries(F.collect_list(F.when(F.col("turn") % 2 == 0, F.struct(F.col("turn").cast("string"), F.concat(F.lit(" note "), "turn")))))
    states = t.groupBy(F.col("conv_id").alias("paper_id")).agg(notes.alias("notes"), ids(3).alias("bookmarks"), ids(4).alias("understood")).withColumn("reader_id", F.lit("r"))
    docs = states.select("paper_id", F.concat(F.lit("title "), "paper_id").alias("title"), F.lit("file").alias("sourceFileName"), F.lit("sha").alias("sourceSha256"))
    return sinks.notes_markdown(segs, states, docs, F.lit("now")).select(F.col("paper_id").alias("conv_id"), F.md5("markdown").alias("markdown"))


@query(f"WITH {V.ACTIONS} SELECT user_id, k, max_by(event_type, (ts, event_id)) AS event_type FROM acts GROUP BY 1, 2")
def streamed_states(spark, d):
    """The action log as a stream: each micro-batch is folded into the stored states."""
    name = V.table(spark, d, "events")
    stream = spark.readStream.schema(name.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", "event_id", "event_type")
    path = shared_folder(spark)
    running = streamed.autosave(rows, f"{path}/states", f"{path}/log", ["user_id", "k"], ["ts", "event_id"], "event_type").trigger(availableNow=True).start()
    running.awaitTermination()
    return streamed.saved(spark, f"{path}/states", ["user_id", "k"], ["ts", "event_id"], "event_type").select("user_id", "k", "event_type")


@query(f"WITH {V.ACTIONS} SELECT user_id, k, max_by(event_type, (ts, event_id)) AS event_type FROM acts GROUP BY 1, 2")
def autosaved_batches(spark, d):
    """The action log in seven batches out of order, one of them stored twice."""
    rows = V.actions(spark, d).select("user_id", "k", "ts", "event_id", "event_type")
    key, order, path = ["user_id", "k"], ["ts", "event_id"], f"{shared_folder(spark)}/states"
    save = streamed.saver(path, key, order, "event_type", fanin=2)
    for number in range(7):
        part = rows.filter(F.col("event_id") % 7 == (number * 3) % 7)
        save(part, number)
        if number == 4:
            save(part, number)
    return streamed.saved(spark, path, key, order, "event_type", fanin=2).select("user_id", "k", "event_type")


#: A user is a view and events are its requests, numbered in order; each is answered after some minutes, every fifth twice.
_RESPONSES = """WITH q AS (SELECT user_id AS view, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, ts, event_id, event_type FROM events),
  r AS (SELECT view, number, date_trunc('second', ts) + to_seconds((event_id * 7919) % 40000) AS "at", event_type AS body FROM q
        UNION ALL SELECT view, number, date_trunc('second', ts) + to_seconds((event_id * 7919) % 40000 + 60), 'again' FROM q WHERE event_id % 5 = 0),
  n AS (SELECT r.*, (SELECT max(number) FROM q WHERE q.view = r.view AND date_trunc('second', q.ts) <= r."at") AS newest FROM r)
  SELECT view, number, CAST(epoch(min("at")) AS BIGINT) AS second, arg_min(body, ("at", body)) AS body FROM n WHERE number = newest GROUP BY 1, 2"""


def _responses(spark, d):
    e = V.table(spark, d, "events")
    second = F.date_trunc("second", "ts")
    asked = e.select(F.col("user_id").alias("view"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("number"), second.alias("sent"), "event_id", "event_type")
    later = lambda more: F.timestamp_seconds(F.unix_timestamp("sent") + F.col("event_id") * 7919 % 40_000 + more)
    row = lambda kind, at, body: ("view", "number", F.lit(kind).alias("kind"), at.alias("at"), body.alias("body"), "event_id")
    rows = asked.select(*row("request", F.col("sent"), F.lit("")))
    rows = rows.unionByName(asked.select(*row("response", later(0), F.col("event_type"))))
    return rows.unionByName(asked.filter("event_id % 5 = 0").select(*row("response", later(60), F.lit("again"))))


def _shown(rows):
    return rows.select("view", "number", F.unix_timestamp("at").alias("second"), "body")


@query(_RESPONSES)
def shown_responses(spark, d):
    return _shown(responses.accepted(_responses(spark, d).drop("event_id")))


@query(_RESPONSES)
def streamed_responses(spark, d):
    """The same log as a stream: three files, whose rows come up to an hour late, and one that moves the watermark past all."""
    path = shared_folder(spark)
    rows = _responses(spark, d).withColumn("came", F.unix_timestamp("at") + F.col("event_id") % 3600)
    ends = rows.agg(F.min("came").alias("a"), F.max("came").alias("z")).first()
    if ends.a is None:
        return _shown(responses.accepted(rows.select("view", "number", "kind", "at", "body")))
    part = F.least(F.floor((F.col("came") - ends.a) * 3 / F.greatest(F.lit(ends.z - ends.a), F.lit(1))), F.lit(2))
    dealt = rows.withColumn("part", part).select("view", "number", "kind", "at", "body", "part")
    dealt.repartition(3, "part").write.parquet(f"{path}/dealt")
    log = spark.read.parquet(f"{path}/dealt")
    for k in range(3):  # files are read in the order in which they were written
        log.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/log")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("view"), F.lit(0).cast("long").alias("number"), F.lit("request").alias("kind"), F.timestamp_seconds(F.lit(ends.z + 7 * 86_400)).alias("at"), F.lit("").alias("body"))
    end.write.mode("append").parquet(f"{path}/log")
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    running = responses.latest_only(stream, "3600 seconds").writeStream.format("parquet").option("path", f"{path}/shown").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return _shown(spark.read.schema("view long, number long, at timestamp, body string").parquet(f"{path}/shown"))
