"""Named queries of the corpus engine, each with the SQL that gives the same rows.

QUERIES maps a name to (function of (spark, sf_dir), SQL or None). Queries run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import geometry, labels, text
from glossa.operators import edits, merge, quality, reports, state
from glossa.operators import links as L
from glossa.operators import segments as S
from glossa.operators.containment import containing
from glossa.plans import views as V

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return S.visible(V.segments(spark, d), V.papers(spark, d), V.exhibits(spark, d))


@query(f"WITH {V.VISIBLE} SELECT paper_id, id, ord, kind FROM vis")
def visible_segments(spark, d):
    return _visible(spark, d).select("paper_id", "id", F.col("order").alias("ord"), "kind")


@query(f"WITH {V.VISIBLE} SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS position FROM vis")
def renumber_visible(spark, d):
    return S.renumbered(_visible(spark, d), ["paper_id"], "order", to="position").select("paper_id", "id", F.col("position").cast("long").alias("position"))


@query(
    f"WITH {V.VISIBLE}, {V.ACTIONS}, seen AS (SELECT DISTINCT user_id AS paper_id, user_id || '-' || (k + 1) AS id FROM acts), n AS (SELECT paper_id, count(*) AS visible FROM vis GROUP BY 1), "
    "h AS (SELECT v.paper_id, count(*) AS seen FROM vis v JOIN seen USING (paper_id, id) GROUP BY 1) "
    "SELECT paper_id, coalesce(seen, 0) AS seen, visible, CAST(floor(coalesce(seen, 0) * 100.0 / visible + 0.5) AS BIGINT) AS percent FROM n LEFT JOIN h USING (paper_id)"
)
def reading_progress(spark, d):
    seen = V.actions(spark, d).select(F.col("user_id").alias("paper_id"), F.concat("user_id", F.lit("-"), F.col("k") + 1).alias("id"))
    return state.progress(seen, _visible(spark, d))


@query(
    f"WITH {V.SEGMENTS}, x AS (SELECT *, coalesce(excluded, false) AS e FROM segs) SELECT paper_id, count(*) FILTER (NOT e) AS included, count(*) FILTER (e) AS excluded, "
    "count(*) FILTER (NOT e AND review = 'reviewed') AS reviewed, count(*) FILTER (NOT e AND translation = 'ai-draft') AS drafted FROM x GROUP BY 1"
)
def editor_counters(spark, d):
    return reports.editor_counters(V.segments(spark, d))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def citation_containment(spark, d):
    b = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return containing(V.table(spark, d, "documents"), "doc_id", "text", b, "quote").select("doc_id", "item_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def citation_containment_exchanged(spark, d):
    """The same rows by the way that lists of quotes of any size take."""
    b = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return containing(V.table(spark, d, "documents"), "doc_id", "text", b, "quote", small_bytes=0).select("doc_id", "item_id")


@query("WITH n AS (SELECT DISTINCT n_name AS word FROM nation UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT substr(text, 1, 40) FROM documents UNION SELECT '' UNION SELECT lang FROM documents) SELECT word, count(*) AS n_documents FROM documents d JOIN n ON contains(d.text, n.word) GROUP BY word")
def quoted_beginnings(spark, d):
    """Quotes of all lengths: names of parts, languages, an empty one, and what each document begins with."""
    docs = V.table(spark, d, "documents")
    words = V.table(spark, d, "nation").select(F.col("n_name").alias("word")).union(V.table(spark, d, "part").select("p_name")).union(docs.select(F.substring("text", 1, 40))).union(docs.select("lang")).union(docs.select(F.lit("")))
    return containing(docs, "doc_id", "text", words.distinct(), "word", small_bytes=0).groupBy("word").agg(F.count("*").alias("n_documents"))


@query("SELECT item_id, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_document FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def citing_documents(spark, d):
    return citation_containment(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.min("doc_id").alias("first_document"))


_FORWARD = (
    "SELECT conv_id, turn, coalesce((SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn >= a.turn), "
    "(SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant')) AS resolved FROM conversations a"
)


@query(_FORWARD)
def resolve_forward(spark, d):
    return S.forward(V.turns(spark, d), F.col("role") == "assistant", ["conv_id"], "turn", "turn").select("conv_id", "turn", "resolved")


@query("SELECT b.conv_id, b.turn AS target, a.turn AS child FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'system'")
def merged_children(spark, d):
    rows = V.turns(spark, d).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("id"), F.col("turn").alias("order"), F.lit("body").alias("kind"), F.when(F.col("role") == "system", F.col("turn") + 1).alias("mergedIntoSegmentId"))
    got = S.merged_children(rows).join(rows.select("paper_id", F.col("id").alias("target")), ["paper_id", "target"], "left_semi")
    return got.select(F.col("paper_id").alias("conv_id"), "target", "child")


#: Orders are segments, parts (but every tenth) exhibits; an order whose key ends in 3 was merged into the one after it. A
#: link quotes its order's priority; every ninth quotes what is no longer there.
_KEPT = f"""WITH {V.PAIRS}, {V.CORRECTIONS},
  l AS (SELECT p.* FROM pairs p JOIN orders ON o_orderkey = segment WHERE (segment + exhibit) % 9 <> 0),
  e AS (SELECT c.segment AS segment, exhibit, action, 1 AS own, c.segment AS ord FROM corr c JOIN orders ON o_orderkey = c.segment
        UNION ALL SELECT c.segment + 1, exhibit, action, 0, c.segment FROM corr c JOIN orders ON o_orderkey = c.segment WHERE c.segment % 10 = 3),
  f AS (SELECT segment, exhibit, arg_max(action, (own, ord)) AS action FROM e GROUP BY 1, 2),
  j AS (SELECT l.*, f.action FROM l LEFT JOIN f USING (segment, exhibit)),
  a AS (SELECT segment, exhibit, method, 'high' AS confidence, 'accepted' AS status FROM j WHERE coalesce(action, '') <> 'exclude' AND (confidence = 'high' OR coalesce(action, '') = 'include')),
  c AS (SELECT segment, exhibit, method, confidence, 'candidate' AS status FROM j WHERE confidence = 'candidate' AND action IS NULL),
  s AS (SELECT f.segment, f.exhibit, 'semantic' AS method, 'high' AS confidence, 'accepted' AS status FROM f WHERE action = 'include'
        AND f.segment IN (SELECT o_orderkey FROM orders) AND f.exhibit IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) AND NOT EXISTS (SELECT 1 FROM a WHERE a.segment = f.segment AND a.exhibit = f.exhibit)),
  r AS (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s)"""


def _links(spark, d):
    one, key = F.lit(0).alias("paper_id"), F.col("o_orderkey")
    orders = V.table(spark, d, "orders").select(one, key.alias("id"), key.alias("order"), F.col("o_orderpriority").alias("sourceText"), F.when(key % 10 == 3, key + 1).alias("mergedIntoSegmentId"), "o_orderstatus")
    exhibits = V.table(spark, d, "part").filter("p_partkey % 10 <> 0").select(one, F.col("p_partkey").alias("id"))
    quote = F.when((F.col("segment") + F.col("exhibit")) % 9 == 0, "gone").otherwise(F.col("sourceText"))
    pairs = V.pairs(spark, d).join(orders.select(F.col("id").alias("segment"), "sourceText"), "segment")
    links = pairs.select(one, F.col("segment").alias("segmentId"), F.col("exhibit").alias("exhibitId"), "method", "confidence", F.lit("").alias("relationshipZh"), quote.alias("evidenceQuote"))
    own = V.corrections(spark, d).select(one, F.col("segment").alias("segment_id"), F.col("exhibit").alias("exhibit_id"), "action")
    return L.resolve_links(links, L.effective_corrections(own, orders), orders, exhibits), own, orders


@query(_KEPT + " SELECT segment, exhibit, method, confidence, status FROM r")
def link_corrections(spark, d):
    return _links(spark, d)[0].select(F.col("segmentId").alias("segment"), F.col("exhibitId").alias("exhibit"), "method", "confidence", "status")


@query(
    _KEPT + " SELECT r.exhibit, r.segment, CASE WHEN c.segment IS NOT NULL THEN 'added' WHEN r.method = 'explicit' THEN 'explicit' ELSE 'semantic' END AS label "
    "FROM r LEFT JOIN corr c ON c.segment = r.segment AND c.exhibit = r.exhibit AND c.action = 'include' WHERE r.status = 'accepted' AND r.segment IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')"
)
def exhibit_overview(spark, d):
    resolved, own, orders = _links(spark, d)
    return L.exhibit_overview(resolved, orders.filter("o_orderstatus <> 'F'"), own).select(F.col("exhibit_id").alias("exhibit"), F.col("segment_id").alias("segment"), "label")


@query(f"WITH {V.PAIRS} SELECT p_partkey AS part, p_partkey IN (SELECT exhibit FROM pairs WHERE confidence = 'high') AS is_linked FROM part")
def linked_flag(spark, d):
    parts = V.table(spark, d, "part").select(F.lit(0).alias("paper_id"), F.col("p_partkey").alias("id"))
    links = V.pairs(spark, d).select(F.lit(0).alias("paper_id"), F.col("exhibit").alias("exhibitId"), "confidence")
    return L.linked_flags(parts, links).select(F.col("id").alias("part"), "is_linked")


@query(
    "SELECT o_orderkey, u.k AS position, c_custkey, c_name FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS k, unnest([o_custkey, o_custkey + 1, -1]) AS id FROM orders) u JOIN customer ON c_custkey = u.id"
)
def exhibit_ids_join(spark, d):
    rows = V.table(spark, d, "orders").select(F.lit(0).alias("paper_id"), F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.lit(-1).cast("long")).alias("exhibitIds"))
    customers = V.table(spark, d, "customer").select(F.lit(0).alias("paper_id"), F.col("c_custkey").alias("id"), "c_name")
    return L.segment_exhibits(rows, customers).select(F.col("id").alias("o_orderkey"), "position", F.col("exhibitId").alias("c_custkey"), "c_name")


@query(
    "SELECT conv_id, turn, row_number() OVER w - 1 AS idx, coalesce(lag(turn) OVER w, turn) AS previous, coalesce(lead(turn) OVER w, turn) AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
)
def nav_prev_next(spark, d):
    return S.neighbours(V.turns(spark, d), ["conv_id"], "turn", "turn").select("conv_id", "turn", F.col("index").cast("long").alias("idx"), "previous", F.col("next").alias("following"))


@query("SELECT conv_id, min(turn) AS first_id, max(turn) AS last_id FROM conversations WHERE role = 'assistant' GROUP BY 1")
def default_position(spark, d):
    return S.ends(V.turns(spark, d).filter("role = 'assistant'"), ["conv_id"], "turn", "turn")


@query("SELECT l_orderkey, string_agg(n, '、' ORDER BY n) AS pages FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem) GROUP BY 1")
def pages_joined(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("page")))).alias("fragments"))
    return rows.select("l_orderkey", S.pages().alias("pages"))


@query("SELECT md5(lower(trim(text))) AS key, count(*) AS n FROM documents GROUP BY lower(trim(text)) HAVING count(*) > 1")
def duplicate_ids(spark, d):
    rows = V.table(spark, d, "documents").select(F.md5(F.lower(F.trim("text"))).alias("key"))
    return reports.duplicates(rows, "key")


@query(
    f"WITH {V.SEGMENTS}, x AS (SELECT paper_id, CAST(floor((ord - 1) / 10) AS BIGINT) AS page, kind, coalesce(excluded, false) AS e, id FROM segs) SELECT paper_id, page, count(*) FILTER (NOT e AND kind <> 'caption') AS units, "
    "count(*) FILTER (e) AS excluded, count(*) FILTER (kind = 'caption') AS boxes FROM x GROUP BY 1, 2"
)
def page_report(spark, d):
    rows = V.segments(spark, d).withColumn("page", F.floor((F.col("order") - 1) / 10))
    out = F.coalesce("excluded", F.lit(False))
    return reports.page_report(rows.filter(~out & (F.col("kind") != "caption")), rows.filter(out), rows.filter("kind = 'caption'"))


@query(f"WITH {V.ACTIONS} SELECT user_id, k, max_by(event_type, (ts, event_id)) AS event_type FROM acts GROUP BY 1, 2")
def state_fold(spark, d):
    return state.last_actions(V.actions(spark, d), ["user_id", "k"], ["ts", "event_id"], "event_type")


@query(f"WITH {V.ACTIONS} SELECT user_id, k, count(*) % 2 = 1 AS is_on FROM acts GROUP BY 1, 2")
def toggle_parity(spark, d):
    return state.toggled(V.actions(spark, d), ["user_id", "k"])


@query(f"WITH {V.ACTIONS} SELECT user_id, k, max_by(event_type, (ts, event_id)) AS note FROM acts GROUP BY 1, 2")
def notes_map(spark, d):
    notes = state.folded_notes(V.actions(spark, d), "user_id", "k", "event_type", ["ts", "event_id"])
    return notes.select("user_id", F.explode("notes").alias("k", "note"))


@query(
    f"WITH {V.VISIBLE}, {V.ACTIONS}, s AS (SELECT DISTINCT user_id AS paper_id, user_id || '-' || (k + 1) AS id, event_type FROM acts) SELECT paper_id, "
    "count(DISTINCT id) FILTER (id IN (SELECT id FROM vis)) AS seen, count(DISTINCT id) FILTER (event_type = 'click' AND id IN (SELECT id FROM segs)) AS bookmarks FROM s GROUP BY 1"
)
def prune_state(spark, d):
    rows = V.actions(spark, d).select(F.col("user_id").alias("paper_id"), F.col("user_id").alias("reader_id"), F.concat("user_id", F.lit("-"), F.col("k") + 1).alias("id"), "event_type")
    click = F.collect_set(F.when(F.col("event_type") == "click", F.col("id")))
    states = rows.groupBy("paper_id", "reader_id").agg(F.collect_set("id").alias("seen"), click.alias("bookmarks")).withColumns({"understood": F.col("bookmarks"), "notes": F.from_json(F.lit("{}"), "map<string,string>")})
    got = state.pruned(states, V.segments(spark, d), _visible(spark, d))
    return got.select("paper_id", F.size("seen").cast("long").alias("seen"), F.size("bookmarks").cast("long").alias("bookmarks"))


_SAID = "'See Table ' || (l_partkey % 120) || ' and Fig. ' || l_linenumber || ', 圖' || (l_suppkey % 7)"


@query(
    f"WITH t AS (SELECT DISTINCT {_SAID} AS said, l_partkey % 120 AS a, l_linenumber AS b, l_suppkey % 7 AS c FROM lineitem), e AS (SELECT p_partkey AS n, CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'figure' END AS kind FROM part WHERE p_partkey % 10 <> 0), "
    "m AS (SELECT said, 'table' AS kind, a AS n FROM t UNION SELECT said, 'figure', b FROM t UNION SELECT said, 'figure', c FROM t) SELECT said, m.kind, CAST(m.n AS VARCHAR) AS number, e.n AS exhibit_id FROM m JOIN e ON e.n = m.n AND e.kind = m.kind"
)
def mention_extract(spark, d):
    said = F.concat(F.lit("See Table "), F.col("l_partkey") % 120, F.lit(" and Fig. "), "l_linenumber", F.lit(", 圖"), F.col("l_suppkey") % 7)
    texts = V.table(spark, d, "lineitem").select(said.alias("said")).distinct().withColumn("paper_id", F.lit(0))
    parts = V.table(spark, d, "part").filter("p_partkey % 10 <> 0")
    exhibits = parts.select(F.lit(0).alias("paper_id"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("position"), F.when(F.col("p_size") % 2 == 0, "table").otherwise("figure").alias("kind"), F.col("p_partkey").cast("string").alias("number"))
    return L.mentioned_exhibits(texts, "said", exhibits).select("said", "kind", "number", "exhibit_id").distinct()


@query("SELECT page_id, url FROM pages WHERE lower(url) LIKE 'https://%'")
def https_filter(spark, d):
    return V.table(spark, d, "pages").select("page_id", text.https_url("url").alias("url")).filter("url is not null")


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def html_escape(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(text.html_escape("html")).alias("escaped"))


@query(
    """WITH x AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '"q"' ELSE '\\p' END || chr(10) AS u FROM pages) SELECT page_id, '{"url":"' || replace(replace(replace(replace(replace(replace(u, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '","note":null}' AS json FROM x"""
)
def script_json(spark, d):
    """Every address with a quote or a backslash and a line end, which JSON escapes."""
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, '"q"').otherwise("\\p"), F.lit("\n"))
    return V.table(spark, d, "pages").select("page_id", text.script_json(F.struct(url.alias("url"), F.lit(None).cast("string").alias("note"))).alias("json"))


@query("SELECT doc_id, md5(regexp_replace('ABSTRACT  ' || text, '^Abstract\\s+', '', 'i')) AS stripped FROM documents")
def abstract_strip(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(text.strip_abstract(F.concat(F.lit("ABSTRACT  "), "text"))).alias("stripped"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.ABSTRACT_LABELS.items())


@query(
    f"WITH x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'crossref' WHEN 'view' THEN 'eric' WHEN 'error' THEN 'doaj' ELSE event_type END AS s, CASE WHEN event_id % 3 = 0 THEN 'ERIC' WHEN event_id % 3 = 1 THEN 'As Provided' END AS o FROM events) "
    f"SELECT event_id, CASE WHEN s = 'eric' THEN CASE o WHEN 'ERIC' THEN '{labels.ERIC_LABELS['ERIC']}' WHEN 'As Provided' THEN '{labels.ERIC_LABELS['As Provided']}' ELSE '{labels.ERIC_OTHER_LABEL}' END ELSE CASE s {_LABELS} ELSE '{labels.ABSTRACT_OTHER_LABEL}' END END AS label FROM x"
)
def label_case(spark, d):
    source = F.when(F.col("event_type") == "click", "crossref").when(F.col("event_type") == "view", "eric").when(F.col("event_type") == "error", "doaj").otherwise(F.col("event_type"))
    origin = F.when(F.col("event_id") % 3 == 0, "ERIC").when(F.col("event_id") % 3 == 1, "As Provided")
    return V.table(spark, d, "events").select("event_id", labels.abstract_label(source, origin).alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_part(spark, d):
    return V.table(spark, d, "events").select("event_id", text.date_part(F.col("ts").cast("string")).alias("day"))


@query(
    r"SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(strip_accents(regexp_replace(text, '([À-ÖØ-öø-ÿ])', '\1-', 'g')), '[^a-zA-Z0-9一-鿿]+', '-', 'g'), '-'), 1, 72), ''), 'paper-notes') AS slug FROM documents"
)
def slug(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(
    "SELECT d.doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN lang ELSE '' END, ''), CASE WHEN toxic = 1 THEN source ELSE coalesce(nullif(CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE 'plain' END, ''), nullif(CASE WHEN d.doc_id % 3 = 0 THEN 'faithful' END, ''), source) END) AS said "
    "FROM documents d LEFT JOIN labels l USING (doc_id)"
)
def fallback_text(spark, d):
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    plain, faithful = F.when(F.col("doc_id") % 2 == 0, "").otherwise("plain"), F.when(F.col("doc_id") % 3 == 0, "faithful")
    said = labels.relationship(F.when(F.col("quality") == 1, F.col("lang")).otherwise(""), F.when(F.col("toxic") == 1, "fragment"), F.col("source"), plain, faithful)
    return rows.select("doc_id", said.alias("said"))


@query("SELECT p_partkey, CAST(floor((p_retailprice - p_size) * 300 / 72 + 0.5) AS BIGINT) AS width, greatest(320, CAST(floor((p_retailprice - p_size) * 2.5 + 0.5) AS BIGINT)) AS preview FROM part")
def bbox_pixels(spark, d):
    box = F.array(F.col("p_size").cast("double"), F.lit(0.0), F.col("p_retailprice"), F.lit(10.0))
    return V.table(spark, d, "part").select("p_partkey", geometry.pixels(F.col("p_size"), F.col("p_retailprice")).alias("width"), geometry.preview(box)["width"].alias("preview"))


@query("SELECT p_partkey, greatest(16, least(28, p_size)) AS font, greatest(CAST(0.5 AS DOUBLE), least(4.0, p_retailprice / 500)) AS zoom FROM part")
def clamp(spark, d):
    return V.table(spark, d, "part").select("p_partkey", geometry.clamp(F.col("p_size"), 16, 28).alias("font"), geometry.clamp(F.col("p_retailprice") / 500, 0.5, 4.0).alias("zoom"))


@query(
    "WITH x AS (SELECT conv_id, turn, text, lead(text) OVER w AS t2, lead(turn) OVER w AS n, lag(turn) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND n IS NOT NULL THEN turn || '-merged' ELSE CAST(turn AS VARCHAR) END AS id, md5(CASE WHEN turn % 4 = 0 AND n IS NOT NULL THEN trim(text) || ' ' || trim(t2) ELSE text END) AS body, "
    "CASE WHEN turn % 4 = 0 AND n IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE 0.9 END AS confidence FROM x WHERE p IS NULL OR p % 4 <> 0"
)
def merge_neighbours(spark, d):
    rows = V.turns(spark, d).select("conv_id", "turn", F.col("turn").cast("string").alias("id"), "text", F.lit(0.9).alias("confidence"))
    got = edits.merge_with_next(rows, ["conv_id"], "turn", F.col("turn") % 4 == 0)
    return got.select("conv_id", "turn", "id", F.md5("text").alias("body"), "confidence")


@query(
    "WITH x AS (SELECT conv_id, turn, text, trim(substr(text, 1, 20), ' ' || chr(10)) AS a, trim(substr(text, 21), ' ' || chr(10)) AS b FROM conversations), y AS (SELECT *, a <> '' AND b <> '' AS cut FROM x) "
    "SELECT conv_id, turn, turn || '-a' AS id, md5(a) AS body, CAST(0.45 AS DOUBLE) AS confidence FROM y WHERE cut UNION ALL SELECT conv_id, turn, turn || '-b', md5(b), 0.45 FROM y WHERE cut UNION ALL SELECT conv_id, turn, CAST(turn AS VARCHAR), md5(text), 0.9 FROM y WHERE NOT cut"
)
def split_at(spark, d):
    rows = V.turns(spark, d).select("conv_id", "turn", F.col("turn").cast("string").alias("id"), "text", F.lit(0.9).alias("confidence"))
    return edits.split_at(rows, ["conv_id"], "turn", F.lit(20)).select("conv_id", "turn", "id", F.md5("text").alias("body"), "confidence")


@query(
    f"WITH {V.SEGMENTS} SELECT paper_id, CASE WHEN count(*) FILTER (NOT coalesce(excluded, false)) = 0 THEN 'segments.included' WHEN bool_or(trim(\"sourceText\") = '') THEN 'segment.text' WHEN max(ord) > 40 THEN 'segment.fragments' END AS error FROM segs GROUP BY 1"
)
def dq_curated(spark, d):
    """Documents as edited papers: pages of one line each, at most 40 pages."""
    seg = F.struct(
        "id", "order", "sourceText", "excluded", F.array(F.struct(F.col("order").cast("int").alias("page"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.array(F.lit(1.0), F.lit(1.0)).alias("pageSize"))).alias("fragments"),
        F.struct(F.lit("ai-draft").alias("status"), F.lit("").alias("faithfulZh"), F.lit("").alias("plainZh")).alias("translation"),
    )
    stored = V.segments(spark, d).groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_list(seg)).alias("segments")).withColumns({"schemaVersion": F.lit("1"), "sourceSha256": F.lit("x")})
    source = stored.select("id", "schemaVersion", "sourceSha256", F.lit(40).alias("pageCount"))
    return quality.curated_document(stored, source).select(F.col("id").alias("paper_id"), "error")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper('#' || substr(md5(p_name), 1, 6)) END AS colour FROM part")
def dq_colour(spark, d):
    said = F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("g"))
    return V.table(spark, d, "part").select("p_partkey", quality.colour(said).alias("colour"))


@query("SELECT doc_id, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) BETWEEN 1 AND 2000 AS is_valid FROM documents")
def dq_length(spark, d):
    return V.table(spark, d, "documents").select("doc_id", quality.text_ok(F.col("text"), 2000).alias("is_valid"))


@query(
    "WITH src AS (SELECT conv_id, turn FROM conversations), x AS (SELECT conv_id, turn, turn % 3 <> 2 AS stored, turn % 3 = 2 AND turn % 2 = 1 AS new FROM src) "
    "SELECT conv_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, CASE WHEN stored THEN 'stored' ELSE 'source' END AS origin FROM x WHERE stored OR new"
)
def order_repair(spark, d):
    rows = V.turns(spark, d).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("id"), F.col("turn").alias("order"))
    stored = rows.filter("id % 3 <> 2")
    previous = rows.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.when(F.col("id") % 2 == 0, F.col("id")))).alias("previous_ids"))
    got = merge.order_repair(stored, rows, previous)
    return got.select(F.col("paper_id").alias("conv_id"), "id", F.col("order").cast("long").alias("position"), "origin")


@query(
    "WITH s AS (SELECT c_custkey AS id, c_name AS t, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS role, CASE WHEN c_nationkey % 4 = 0 THEN true END AS e FROM customer WHERE c_custkey % 2 = 0), "
    "n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_name END AS t, 'source-role' AS role, c_acctbal < 0 AS e FROM customer) "
    'SELECT s.id, CASE WHEN s.role IS NULL AND n.t = s.t THEN n.role ELSE s.role END AS "readingRole", CASE WHEN s.e IS NULL AND n.t = s.t AND s.id % 7 <> 0 THEN n.e ELSE s.e END AS excluded FROM s LEFT JOIN n USING (id)'
)
def field_merge(spark, d):
    c = V.table(spark, d, "customer")
    one = F.lit(0).alias("paper_id")
    stored = c.filter("c_custkey % 2 = 0").select(one, F.col("c_custkey").alias("id"), F.col("c_name").alias("sourceText"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).alias("readingRole"), F.when(F.col("c_nationkey") % 4 == 0, F.lit(True)).alias("excluded"))
    source = c.select(one, F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("c_name")).alias("sourceText"), F.lit("source-role").alias("readingRole"), (F.col("c_acctbal") < 0).alias("excluded"))
    protected = stored.filter("id % 7 = 0").select("paper_id", "id")
    return merge.field_merge(stored, source, protected).select("id", "readingRole", "excluded")


@query(
    "WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '#edit:p' || page_id WHEN 1 THEN '#guide:p' || page_id WHEN 2 THEN '#paper=' || (page_id % 100) ELSE 'p' || page_id END AS h FROM pages) "
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'edit' WHEN 1 THEN 'guide' WHEN 2 THEN 'guide' ELSE 'reader' END AS mode, CASE page_id % 4 WHEN 2 THEN 'paper-' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') ELSE 'p' || page_id END AS id FROM x"
)
def route_parse(spark, d):
    p = F.col("page_id")
    hashes = F.when(p % 4 == 0, F.concat(F.lit("#edit:p"), p)).when(p % 4 == 1, F.concat(F.lit("#guide:p"), p)).when(p % 4 == 2, F.concat(F.lit("#paper="), p % 100)).otherwise(F.concat(F.lit("p"), p))
    return V.table(spark, d, "pages").select("page_id", text.route(hashes).alias("r")).select("page_id", "r.mode", "r.id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/base' || '/p/' || p_partkey WHEN p_partkey % 3 = 1 THEN '//host/' || p_partkey ELSE 'rel/' || p_partkey END AS url, lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS label FROM part")
def deployed_urls(spark, d):
    p = F.col("p_partkey")
    url = F.when(p % 3 == 0, F.concat(F.lit("/p/"), p)).when(p % 3 == 1, F.concat(F.lit("//host/"), p)).otherwise(F.concat(F.lit("rel/"), p))
    return V.table(spark, d, "part").select("p_partkey", text.deployed_url(url, "/base/").alias("url"), text.padded("p_partkey", 3).alias("label"))


@query("SELECT s_suppkey, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS previous, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS following, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN n_name END, 'local') AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def guide_versions(spark, d):
    rows = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("paper_id"), "s_nationkey")
    audit = rows.filter("paper_id % 2 = 0").join(V.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("paper_id", F.col("n_name").alias("sha256"))
    got = S.siblings(L.guide_versions(rows, audit), "paper_id", "paper_id", ["s_nationkey"])
    return got.select(F.col("paper_id").alias("s_suppkey"), "previous", F.col("next").alias("following"), "version")


_RESOLVE = f"""WITH {V.VISIBLE}, firsts AS (SELECT paper_id, arg_min(id, ord) AS f, arg_max(id, ord) AS l FROM vis GROUP BY 1),
  papers AS (SELECT doc_id AS paper_id FROM documents), w AS (SELECT paper_id, id AS wanted, ord FROM segs UNION ALL SELECT paper_id, 'unknown', NULL FROM papers),
  led AS (SELECT s.paper_id, s.id, CASE WHEN (s.paper_id || '-2') IN (SELECT id FROM vis) THEN s.paper_id || '-2' END AS target FROM segs s WHERE s.ord = 3 AND s.paper_id % 6 = 0)
  SELECT w.paper_id, wanted, CASE WHEN w.ord IS NULL THEN f WHEN wanted IN (SELECT id FROM vis) THEN wanted
  WHEN w.ord % 5 = 4 AND w.ord % 7 <> 0 AND (w.paper_id || '-' || (w.ord + 1)) IN (SELECT id FROM vis) THEN w.paper_id || '-' || (w.ord + 1)
  ELSE coalesce(led.target, (SELECT arg_min(v.id, v.ord) FROM vis v WHERE v.paper_id = w.paper_id AND v.ord >= w.ord), l) END AS resolved
  FROM w LEFT JOIN firsts USING (paper_id) LEFT JOIN led ON led.paper_id = w.paper_id AND led.id = wanted"""


@query(_RESOLVE)
def resolve_any(spark, d):
    papers, segs, exhibits = V.papers(spark, d), V.segments(spark, d), V.exhibits(spark, d)
    links = exhibits.select("paper_id", F.col("id").alias("exhibitId"), F.concat("paper_id", F.lit("-2")).alias("segmentId"), F.lit("high").alias("confidence"), F.lit(0).alias("position"))
    wanted = segs.select("paper_id", F.col("id").alias("wanted")).unionByName(papers.select("paper_id", F.lit("unknown").alias("wanted")))
    plain = segs.withColumn("mergedIntoSegmentId", F.when((F.col("order") % 5 == 4) & (F.col("order") % 7 != 0), F.concat("paper_id", F.lit("-"), F.col("order") + 1)))
    return S.resolve(wanted, plain, _visible(spark, d), exhibits, links, papers)


@query("SELECT item_id, count(*) AS n_segments, min(doc_id) AS first_paper FROM (SELECT DISTINCT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) <> 1) GROUP BY 1")
def citing_segments(spark, d):
    """Documents as segments, benchmark passages as references; toxic documents are excluded ones."""
    got = citation_containment(spark, d)
    cites = got.select(F.lit(0).alias("paper_id"), F.col("doc_id").alias("segmentId"), F.lit("matched").alias("matchStatus"), F.array("item_id").alias("referenceIds"))
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    segs = docs.select(F.lit(0).alias("paper_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("order"), (F.col("toxic") == 1).alias("excluded"))
    rows = L.citing_segments(L.matched_citations(cites), segs)
    return rows.groupBy(F.col("reference_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_segments"), F.min("segment_id").alias("first_paper"))


@query("SELECT p_partkey AS exhibit, o_orderkey AS segment, k AS position FROM (SELECT p_partkey, unnest([0, 1, 2]) AS k, unnest([p_partkey, p_partkey * 2, p_partkey * 7]) AS id FROM part) JOIN orders ON o_orderkey = id WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'")
def exhibit_explanations(spark, d):
    orders = V.table(spark, d, "orders").select(F.lit(0).alias("paper_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("excluded"), F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "fragment").otherwise("whole").alias("status")).alias("paragraphAssessment"))
    p = F.col("p_partkey")
    exhibits = V.table(spark, d, "part").select(F.lit(0).alias("paper_id"), p.alias("id"), F.array(p, p * 2, p * 7).alias("explanationSegmentIds"))
    return L.explanations(exhibits, orders).select(F.col("exhibit_id").alias("exhibit"), F.col("segment_id").alias("segment"), "position")


@query("SELECT s_nationkey AS paper, s_suppkey AS segment, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY k), '') AS related FROM (SELECT s_nationkey, s_suppkey, unnest([0, 1]) AS k, unnest([s_suppkey, s_suppkey + 1]) AS id FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)) LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 2 = 0) ON c_custkey = id GROUP BY 1, 2")
def current_appendices(spark, d):
    segs = V.table(spark, d, "customer").filter("c_nationkey % 2 = 0").select(F.lit(0).alias("paper_id"), F.col("c_custkey").alias("id"))
    rows = V.table(spark, d, "supplier").select(F.lit(0).alias("paper_id"), F.col("s_nationkey").alias("paper"), F.col("s_suppkey").alias("segmentId"), F.array(F.col("s_suppkey"), F.col("s_suppkey") + 1).alias("relatedSegmentIds"))
    got = merge.current_quality(rows.withColumn("relatedSegmentIds", F.col("relatedSegmentIds").cast("array<string>")).withColumn("segmentId", F.col("segmentId").cast("string")), segs.withColumn("id", F.col("id").cast("string")))
    return got.select("paper", F.col("segmentId").cast("long").alias("segment"), F.array_join("relatedSegmentIds", ",").alias("related"))


@query(f"WITH {V.ACTIONS}, x AS (SELECT user_id, k, value, CASE WHEN k % 5 = 0 THEN 'top' WHEN k % 5 = 1 THEN 'source' ELSE 'floating' END AS dock, event_id FROM acts) SELECT event_id, CASE WHEN dock = 'top' THEN 'layout.dock' WHEN 200 + k * 10 NOT BETWEEN 280 AND 1600 THEN 'layout.size' WHEN k / 10.0 NOT BETWEEN 0.5 AND 4 THEN 'zooms' WHEN event_id % 3 = 0 THEN 'corrections.segment' WHEN event_id % 3 = 1 THEN 'corrections.action' END AS error FROM x")
def dq_companion(spark, d):
    a = V.actions(spark, d)
    k = F.col("k").cast("double")
    layout = F.struct(F.when(F.col("k") % 5 == 0, "top").when(F.col("k") % 5 == 1, "source").otherwise("floating").alias("dock"), (200 + k * 10).alias("width"), F.lit(200.0).alias("height"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(150.0).alias("mobileHeight"))
    segment, action = F.when(F.col("event_id") % 3 == 0, "gone").otherwise("s"), F.when(F.col("event_id") % 3 == 1, "maybe").otherwise("include")
    states = a.select("event_id", F.lit(1).alias("version"), F.lit("p").alias("paperId"), F.lit("h").alias("sourceSha256"), layout.alias("layout"), F.create_map(F.lit("e"), k / 10).alias("zooms"), F.create_map(segment, F.create_map(F.lit("e"), action)).alias("corrections"))
    docs = spark.range(1).select(F.lit("p").alias("paper_id"), F.lit("h").alias("sourceSha256"), F.array(F.lit("s")).alias("segment_ids"), F.array(F.lit("e")).alias("exhibit_ids"))
    return quality.companion_state(states, docs).select("event_id", "error")


@query("SELECT o_orderpriority AS paper_id, count(*) AS total, count(*) FILTER (o_custkey % 10 <> 0) AS rendered, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS suspect, count(*) FILTER (o_orderkey % 2 = 0) AS figures, count(*) FILTER (o_orderkey % 2 = 1) AS tables FROM orders GROUP BY 1")
def crop_counts(spark, d):
    o = V.table(spark, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("paper_id"), F.when(F.col("o_custkey") % 10 != 0, "x.png").alias("output"), F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "suspect").otherwise("failed").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "figure").otherwise("table").alias("kind"))
    return reports.crop_counts(rows).select("paper_id", "total", "rendered", "ok", "suspect", "figures", "tables")


@query("SELECT p_partkey AS paper_id, CASE WHEN p_partkey < 10 THEN '0' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS label, p_name AS title, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 3 = 1 THEN p_size * 2 END, p_size * 3) AS segments FROM part")
def library_cards(spark, d):
    s = F.col("p_size")
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_partkey").alias("number"), F.col("p_name").alias("title"), s.alias("pageCount"), F.when(s % 3 == 0, s).alias("bodySegmentCount"), F.when(s % 3 == 1, s * 2).alias("includedSegmentCount"), (s * 3).alias("segmentCount"))
    return reports.library_cards(rows).drop("pageCount")


@query("WITH x AS (SELECT c_mktsegment AS base, c_custkey % 4 AS r FROM customer), t AS (SELECT DISTINCT base || CASE WHEN r = 0 THEN '' ELSE '-' || (r + 1) END AS id, base FROM x WHERE r <> 2) SELECT base, base || '-3' AS id FROM (SELECT DISTINCT base FROM x)")
def unique_names(spark, d):
    c = V.table(spark, d, "customer").select(F.lit("p").alias("paper_id"), F.col("c_mktsegment").alias("base"), (F.col("c_custkey") % 4).alias("r"))
    taken = c.filter("r <> 2").select("paper_id", F.when(F.col("r") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), (F.col("r") + 1).cast("string"))).alias("id")).distinct()
    return edits.unique_ids(c, taken).select("base", "id")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'term' WHEN turn % 2 = 1 AND role <> 'user' THEN 'stale' ELSE '' END AS warnings FROM conversations")
def explanation_warnings(spark, d):
    rows = V.turns(spark, d).select(F.lit("paper-01").alias("paper_id"), F.concat("conv_id", F.lit("/"), "turn").alias("id"), "conv_id", "turn", F.col("text").alias("sourceText"), F.struct(F.lit("ai-draft").alias("status"), F.when(F.col("role") == "user", "CT（認知訓練").otherwise("說明").alias("plainZh")).alias("translation"), "role")
    repairs = rows.filter("turn % 2 = 1 and role <> 'user'").select("paper_id", "id", "sourceText", F.lit("other").alias("plainZh"))
    got = quality.explanation_warnings(rows, repairs)
    short = F.transform("warnings", lambda w: F.when(w == quality.STALE_WARNING, "stale").otherwise("term"))
    return got.select("conv_id", "turn", F.array_join(short, ",").alias("warnings"))


@query("WITH s AS (SELECT conv_id, turn AS id, turn AS o, CASE WHEN turn % 3 = 0 THEN true END AS e FROM conversations WHERE turn % 5 <> 4), n AS (SELECT conv_id, turn AS id, role = 'system' AS e FROM conversations) SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS position, coalesce(s.e, n.e) AS excluded FROM s JOIN n USING (conv_id, id)")
def reconcile(spark, d):
    t = V.turns(spark, d)
    stored = t.filter("turn % 5 <> 4").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("id"), F.col("turn").alias("order"), F.col("text").alias("sourceText"), F.when(F.col("turn") % 3 == 0, F.lit(True)).alias("excluded"))
    source = t.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("id"), F.col("turn").alias("order"), F.col("text").alias("sourceText"), (F.col("role") == "system").alias("excluded"))
    got = merge.reconcile(stored, source)
    return got.select(F.col("paper_id").alias("conv_id"), "id", F.col("order").cast("long").alias("position"), "excluded")


def _all() -> dict:
    from glossa.plans import pages, readers  # noqa: F401  they put their queries into QUERIES

    return QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
