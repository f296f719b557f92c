"""Named queries of lookups, readers' state, edits and merges, each through the operator that it is named for, with the SQL
that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import geometry, labels, text
from glossa.operators import edits, merge, quality, reports, state, views
from glossa.operators import links as L
from glossa.operators import segments as S
from glossa.plans import views as V
from glossa.plans.corpus import _visible, query

def _one():
    """All rows as one paper's."""
    return F.lit(0).alias("paper_id")


def _orders(spark, d):
    return V.table(spark, d, "orders")


@query(
    f"WITH {V.VISIBLE} SELECT paper_id, CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS label, ord % 5 = 0 AS is_fragment, md5(\"sourceText\") AS body "
    "FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS n FROM vis)"
)
def reading_list(spark, d):
    shown = _visible(spark, d).withColumn("paragraphAssessment", F.struct(F.when(F.col("order") % 5 == 0, "fragment").otherwise("whole").alias("status")))
    return S.reading_list(shown).select("paper_id", "label", "is_fragment", F.md5("sourceText").alias("body"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND o_custkey % 3 <> 0 AND NOT (o_custkey % 5 = 0 AND o_orderkey % 2 = 1) THEN 7 ELSE 1 END AS page, CASE WHEN o_orderkey % 4 <> 0 AND o_custkey % 3 <> 0 AND NOT (o_custkey % 5 = 0 AND o_orderkey % 2 = 1) THEN 1 ELSE 2 END AS boxes FROM orders")
def shown_regions(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    box = lambda page: F.struct(F.lit(page).alias("page"), F.array(F.lit(0.0)).alias("bbox"), F.array(F.lit(9.0)).alias("pageSize"))
    own = F.array(box(7))
    rows = _orders(spark, d).withColumns({"exhibits": F.when(o % 4 == 0, F.slice(own, 1, 0)).otherwise(own), "fragments": F.array(box(1), box(2)), "kind": F.when(o % 2 == 1, "body").otherwise("caption")})
    got = rows.withColumn("r", S.regions(c % 3 == 0, c % 5 == 0))
    return got.select("o_orderkey", F.col("r")[0]["page"].alias("page"), F.size("r").alias("boxes"))


@query(f"WITH {V.SEGMENTS} SELECT paper_id, id FROM segs WHERE ord % 4 = 0")
def evidence_links(spark, d):
    """Links of every second segment; half of them quote a text that is no longer the segment's."""
    segs = V.segments(spark, d)
    quote = F.when(F.col("order") % 4 == 0, F.col("sourceText")).otherwise(F.concat(F.lit("stale "), "sourceText"))
    links = segs.filter("`order` % 2 = 0").select("paper_id", F.col("id").alias("segmentId"), quote.alias("evidenceQuote"))
    return L.valid_links(links, segs).select("paper_id", F.col("segmentId").alias("id"))


@query(f"WITH {V.SEGMENTS} SELECT paper_id, id FROM segs WHERE ord % 3 = 0 AND contains(\"sourceText\", CASE WHEN ord % 2 = 0 THEN substr(\"sourceText\", 3, 12) ELSE '~' || substr(\"sourceText\", 3, 12) END)")
def valid_citations(spark, d):
    segs = V.segments(spark, d)
    part = F.substring("sourceText", 3, 12)
    cites = segs.filter("`order` % 3 = 0").select("paper_id", F.col("id").alias("segmentId"), F.when(F.col("order") % 2 == 0, part).otherwise(F.concat(F.lit("~"), part)).alias("sourceContext"))
    return L.valid_citations(cites, segs).select("paper_id", F.col("segmentId").alias("id"))


@query("SELECT o_orderkey, m AS exhibit FROM (SELECT o_orderkey, unnest([o_custkey % 5, o_orderkey % 5]) AS page, unnest([1, 2]) AS m FROM orders) WHERE page = 3")
def page_mentions(spark, d):
    mention = lambda page, e: F.struct(page.alias("page"), F.lit(e).alias("exhibitId"))
    rows = _orders(spark, d).select("o_orderkey", F.array(mention(F.col("o_custkey") % 5, 1), mention(F.col("o_orderkey") % 5, 2)).alias("exhibitMentions"))
    return L.mentions_on_page(rows, 3).select("o_orderkey", F.col("mention.exhibitId").alias("exhibit"))


_RELATED = "SELECT DISTINCT p_partkey, id FROM (SELECT p_partkey, unnest([p_partkey, p_partkey * 3, p_partkey * 7, p_partkey]) AS id FROM part) JOIN orders ON o_orderkey = id"


def _related(spark, d, keep_excluded):
    p = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(_one(), p, F.array(p, p * 3, p * 7, p).alias("relatedSegmentIds"))
    segs = _orders(spark, d).select(_one(), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("excluded"))
    return L.existing_related(rows, "relatedSegmentIds", segs, keep_excluded).select("p_partkey", F.col("related").alias("id"))


@query(_RELATED)
def related_segments(spark, d):
    return _related(spark, d, True)


@query(_RELATED + " WHERE o_orderstatus <> 'F'")
def related_passages(spark, d):
    return _related(spark, d, False)


@query("SELECT conv_id, turn FROM conversations a WHERE turn % 3 = 0 AND (turn + 1) % 4 IN (0, 1) AND turn % 2 = 0")
def caption_remains(spark, d):
    """Turns merged into the next; captions are every fourth turn and the one after; even turns carry notes."""
    rows = V.turns(spark, d).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("id"), F.when(F.col("turn") % 3 == 0, F.col("turn") + 1).alias("mergedIntoSegmentId"))
    captions = rows.select("paper_id", (F.col("id") + 1).alias("caption")).filter("caption % 4 in (0, 1)")
    noted = rows.filter("id % 2 = 0").select("paper_id", F.col("id").alias("segment_id"))
    return L.caption_remains(rows, captions, noted).select(F.col("paper_id").alias("conv_id"), F.col("id").alias("turn"))


@query("SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2")
def exhibit_lookup(spark, d):
    rows = _orders(spark, d).select(_one(), "o_orderkey", (F.col("o_custkey") * 2).alias("exhibitId"))
    exhibits = V.table(spark, d, "customer").select(_one(), F.col("c_custkey").alias("id"), "c_name")
    return L.exhibit_by_id(rows, "exhibitId", exhibits).select("o_orderkey", F.col("exhibit.c_name").alias("name"))


@query(f"WITH {V.PAIRS} SELECT p_partkey FROM part WHERE p_partkey = 150 OR p_partkey IN (SELECT exhibit FROM pairs WHERE confidence = 'high' AND segment % 10 = 0)")
def open_exhibits(spark, d):
    exhibits = V.table(spark, d, "part").select(_one(), F.col("p_partkey").cast("string").alias("id"))
    accepted = V.pairs(spark, d).filter("confidence = 'high' and segment % 10 = 0").select(_one(), F.col("exhibit").cast("string").alias("exhibitId"))
    return L.accepted_or_selected(exhibits, accepted, "150").select(F.col("id").cast("long").alias("p_partkey"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS reference FROM documents")
def chosen_references(spark, d):
    k = F.col("doc_id") % 3
    status = F.when(k == 0, "matched").when(k == 1, "ambiguous").otherwise("unmatched")
    return V.table(spark, d, "documents").select("doc_id", L.chosen_reference(status, F.array("source", "lang")).alias("reference"))


@query(
    "WITH x AS (SELECT user_id, ts, event_id, CASE WHEN event_type NOT IN ('error', 'purchase') THEN event_id END AS target FROM events), "
    "s AS (SELECT *, sum(CASE WHEN target IS NULL THEN -1 ELSE 1 END) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "z AS (SELECT *, n - least(min(n) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS depth FROM s), "
    "l AS (SELECT *, min(depth) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM z) "
    "SELECT user_id, CAST(depth AS BIGINT) AS depth, target FROM l WHERE target IS NOT NULL AND coalesce(later >= depth, true)"
)
def back_positions(spark, d):
    """Where each user can go back to: two of five events go back, the others lead somewhere."""
    e = V.table(spark, d, "events")
    visits = e.select("user_id", "ts", "event_id", F.when(~F.col("event_type").isin("error", "purchase"), F.col("event_id")).alias("target"))
    return state.back_stack(visits, "user_id", ["ts", "event_id"], "target")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'A1' WHEN p_partkey % 4 = 1 THEN 'A' WHEN p_partkey % 4 = 2 THEN 'B.c' END AS node FROM part")
def element_nodes(spark, d):
    """Ids of drawn elements to nodes: the longest node id between dashes, else the data id; a node id may hold pattern signs."""
    p = F.col("p_partkey")
    name = F.when(p % 4 == 0, "flowchart-A1-").when(p % 4 == 1, "flowchart-A-").when(p % 4 == 2, "x-").otherwise("B-c-")
    elements = V.table(spark, d, "part").select(F.concat(name, p.cast("string")).alias("element_id"), F.when(p % 4 == 2, "B.c").alias("data_id"))
    nodes = spark.createDataFrame([("A",), ("A1",), ("B.c",)], "node_id string")
    from glossa.operators import study

    return study.node_of_element(elements, nodes).select(F.regexp_extract("element_id", "([0-9]+)$", 1).cast("long").alias("p_partkey"), F.col("node_id").alias("node"))


@query("SELECT o_orderkey, o_orderkey % 7 = o_custkey % 7 AS is_caption, o_orderkey % 7 IN (o_custkey % 3, 5) AS is_explanation FROM orders")
def exhibit_roles(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return _orders(spark, d).select("o_orderkey", L.exhibit_role(o % 7, c % 7, F.array(c % 3, F.lit(5).cast("long"))).alias("r")).select("o_orderkey", "r.is_caption", "r.is_explanation")


@query("SELECT page_id, CASE WHEN page_id * 5 IN (SELECT doc_id FROM documents) THEN 'paper' ELSE 'library' END AS view FROM pages")
def routed_papers(spark, d):
    routes = V.table(spark, d, "pages").select("page_id", (F.col("page_id") * 5).alias("id"))
    return L.routed_papers(routes, V.papers(spark, d)).select("page_id", "view")


@query(
    "WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') SELECT c.conv_id, coalesce((SELECT min(turn) FROM a WHERE a.conv_id = c.conv_id AND turn >= c.conv_id % 9 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.conv_id % 9)), "
    "(SELECT max(turn) FROM a WHERE a.conv_id = c.conv_id AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.conv_id % 9)), (SELECT min(turn) FROM a WHERE a.conv_id = c.conv_id)) AS turn FROM (SELECT DISTINCT conv_id FROM conversations) c"
)
def restore_position(spark, d):
    """A stored turn of every conversation (some don't exist) becomes one of the assistant's that can be shown."""
    t = V.turns(spark, d).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("id"), F.col("turn").alias("order"), "role")
    shown = t.filter("role = 'assistant'")
    resolved = S.forward(t, F.col("role") == "assistant", ["paper_id"], "order", "id").select("paper_id", F.col("id").alias("wanted"), "resolved")
    states = t.select("paper_id").distinct().withColumn("currentSegmentId", F.col("paper_id") % 9)
    return state.restored(states, shown, resolved).select(F.col("paper_id").alias("conv_id"), F.col("currentSegmentId").alias("turn"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'mine' WHEN o_custkey % 3 = 1 THEN 'first' END AS exhibit FROM orders")
def selected_exhibit(spark, d):
    k = F.col("o_custkey") % 3
    accepted = F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("first"), F.lit("second")))
    return _orders(spark, d).select("o_orderkey", L.selected_exhibit(F.when(k == 0, "mine"), accepted).alias("exhibit"))


@query(f"WITH {V.PAIRS} SELECT segment, exhibit, CASE WHEN confidence = 'high' THEN 'accepted' ELSE 'candidate' END AS status, p_name AS label FROM pairs LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = exhibit WHERE confidence = 'candidate' OR p_name IS NOT NULL")
def labelled_links(spark, d):
    resolved = V.pairs(spark, d).select(_one(), F.col("segment").alias("segmentId"), F.col("exhibit").alias("exhibitId"), F.when(F.col("confidence") == "high", "accepted").otherwise("candidate").alias("status"))
    exhibits = V.table(spark, d, "part").filter("p_partkey % 10 <> 0").select(_one(), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return L.labelled_links(resolved, exhibits).select(F.col("segmentId").alias("segment"), F.col("exhibitId").alias("exhibit"), "status", F.col("exhibit_label").alias("label"))


@query(
    f"WITH {V.PAIRS}, c AS (SELECT event_id % 1000 AS id, count(*) AS n FROM events GROUP BY 1), p AS (SELECT segment AS id, count(*) FILTER (confidence = 'high') AS a, count(*) FILTER (confidence <> 'high') AS b FROM pairs GROUP BY 1), "
    "x AS (SELECT p_partkey * 7 AS id, count(*) AS n FROM part GROUP BY 1) SELECT o_orderkey, coalesce(c.n, 0) AS citations, coalesce(a, 0) AS accepted, coalesce(b, 0) AS candidates, coalesce(x.n, 0) AS explains "
    "FROM orders LEFT JOIN c ON c.id = o_orderkey LEFT JOIN p ON p.id = o_orderkey LEFT JOIN x ON x.id = o_orderkey"
)
def view_counts(spark, d):
    segs = _orders(spark, d).select(_one(), F.col("o_orderkey").alias("id"))
    cites = V.table(spark, d, "events").select(_one(), (F.col("event_id") % 1000).alias("segmentId"))
    resolved = V.pairs(spark, d).select(_one(), F.col("segment").alias("segmentId"), F.when(F.col("confidence") == "high", "accepted").otherwise("candidate").alias("status"))
    explains = V.table(spark, d, "part").select(_one(), F.col("p_partkey").alias("exhibit_id"), (F.col("p_partkey") * 7).alias("segment_id"))
    return reports.view_counts(segs, cites, explains, resolved).withColumnRenamed("id", "o_orderkey").drop("paper_id")


@query("SELECT p_partkey, (SELECT count(*) FROM orders WHERE o_custkey = p_partkey) AS explanations FROM part")
def exhibit_counts(spark, d):
    exhibits = V.table(spark, d, "part").select(_one(), F.col("p_partkey").alias("id"))
    rows = _orders(spark, d).select(_one(), F.col("o_custkey").alias("exhibit_id"), F.col("o_orderkey").alias("segment_id"))
    return reports.exhibit_counts(exhibits, rows).select(F.col("id").alias("p_partkey"), "explanations")


@query(f"WITH {V.PAIRS} SELECT exhibit, md5(string_agg(CAST(segment AS VARCHAR), ',' ORDER BY segment)) AS segments FROM pairs GROUP BY 1")
def ordered_segments(spark, d):
    got = S.in_order(V.pairs(spark, d), ["exhibit"], "segment", "segment")
    return got.select("exhibit", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("segments"))


@query("SELECT conv_id, CASE turn WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE turn END AS position, role FROM conversations")
def swapped_neighbours(spark, d):
    return edits.swapped(V.turns(spark, d), "turn", 1).select("conv_id", F.col("turn").cast("long").alias("position"), "role")


_XS = "[o_custkey % 3, o_orderkey % 3, 1]"


@query(
    f"WITH x AS (SELECT o_orderkey, {_XS} AS xs, o_orderkey % 4 AS y FROM orders) SELECT o_orderkey, array_to_string(list_filter(xs, lambda v, i: list_position(xs, v) = i), ',') AS once, "
    "array_to_string(CASE WHEN list_contains(xs, y) THEN xs ELSE list_append(xs, y) END, ',') AS added, array_to_string(CASE WHEN list_contains(xs, y) THEN list_filter(xs, lambda v: v <> y) ELSE list_append(xs, y) END, ',') AS toggled FROM x"
)
def set_operations(spark, d):
    xs, y = F.array(F.col("o_custkey") % 3, F.col("o_orderkey") % 3, F.lit(1).cast("long")), F.col("o_orderkey") % 4
    said = lambda c, name: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(name)
    return _orders(spark, d).select("o_orderkey", said(state.distinct(xs), "once"), said(state.add(xs, y), "added"), said(state.toggle(xs, y), "toggled"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = o_orderkey % 2 THEN 1 ELSE 2 END AS boxes, o_custkey % 2 AS first_page FROM orders")
def distinct_fragments(spark, d):
    a, b = F.col("o_custkey") % 2, F.col("o_orderkey") % 2
    box = lambda p: F.struct(p.alias("page"), F.array(p.cast("double"), F.lit(1.0)).alias("bbox"), F.rand(1).alias("other"))
    rows = _orders(spark, d).select("o_orderkey", F.array(box(a), box(b), box(a)).alias("fragments")).withColumn("f", S.distinct_fragments())
    return rows.select("o_orderkey", F.size("f").alias("boxes"), F.col("f")[0]["page"].alias("first_page"))


@query(
    "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 't' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'e' ELSE 'f' END AS e, CASE o_orderkey % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' END AS a FROM orders) "
    "SELECT o_orderkey, CASE WHEN s = 's' AND e = 'e' THEN a ELSE 'include' END AS s_e, CASE WHEN s = 's' AND e = 'f' THEN a END AS s_f, CASE WHEN s = 't' AND e = 'e' THEN a END AS t_e, CASE WHEN s = 't' AND e = 'f' THEN a END AS t_f FROM x"
)
def set_corrections(spark, d):
    o = F.col("o_orderkey")
    old = F.from_json(F.lit('{"s":{"e":"include"}}'), "map<string,map<string,string>>")
    new = state.correct(old, F.when(o % 2 == 0, "s").otherwise("t"), F.when(o % 3 == 0, "e").otherwise("f"), F.when(o % 4 == 0, "include").when(o % 4 == 1, "exclude"))
    rows = _orders(spark, d).select("o_orderkey", new.alias("c"))
    at = lambda s, e: F.try_element_at(F.try_element_at("c", F.lit(s)), F.lit(e)).alias(f"{s}_{e}")
    return rows.select("o_orderkey", at("s", "e"), at("s", "f"), at("t", "e"), at("t", "f"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 9 END AS a, CASE o_orderkey % 4 WHEN 1 THEN 'x' ELSE 'd' END AS b FROM orders")
def stored_defaults(spark, d):
    """Stored JSON over defaults; an explicit null wins, broken text counts as nothing."""
    k = F.col("o_orderkey") % 4
    stored = F.when(k == 0, '{"a":1}').when(k == 1, '{"a":null,"b":"x"}').when(k == 2, "{broken")
    rows = _orders(spark, d).select("o_orderkey", state.with_defaults(stored, F.struct(F.lit(9).alias("a"), F.lit("d").alias("b")), {"a": "int", "b": "string"}).alias("s"))
    return rows.select("o_orderkey", "s.a", "s.b")


_STATE = "SELECT user_id, user_id || '-' || (k + 1) AS id, event_type, (ts, event_id) AS tick FROM acts"


@query(
    f"WITH {V.VISIBLE}, {V.ACTIONS}, s AS ({_STATE}), last AS (SELECT user_id, arg_max(id, tick) AS cur FROM s GROUP BY 1), first AS (SELECT paper_id, arg_min(id, ord) AS f FROM vis GROUP BY 1), "
    "cur AS (SELECT user_id, coalesce(CASE WHEN cur IN (SELECT id FROM vis) THEN cur END, f) AS c FROM last LEFT JOIN first ON paper_id = user_id), "
    "seen AS (SELECT user_id, id FROM s WHERE id IN (SELECT id FROM vis) UNION SELECT user_id, c FROM cur WHERE c IS NOT NULL) "
    "SELECT cur.user_id, c AS position, (SELECT count(*) FROM seen WHERE seen.user_id = cur.user_id AND c IS NOT NULL) AS seen FROM cur WHERE cur.user_id % 3 <> 2 AND cur.user_id IN (SELECT doc_id FROM documents)"
)
def imported_backups(spark, d):
    """Backups made of the action log; every third has another source hash and is refused."""
    a = V.actions(spark, d).select("user_id", F.concat("user_id", F.lit("-"), F.col("k") + 1).alias("id"), F.struct("ts", "event_id").alias("at"))
    none = F.array().cast("array<string>")
    backups = a.groupBy(F.col("user_id").alias("reader_id")).agg(F.max_by("id", "at").alias("currentSegmentId"), F.collect_set("id").alias("seen")).select(
        "reader_id", F.lit(1).alias("version"), F.col("reader_id").alias("paperId"), F.when(F.col("reader_id") % 3 == 2, "old").otherwise("h").alias("sourceSha256"), "currentSegmentId", "seen",
        none.alias("understood"), none.alias("bookmarks"), F.from_json(F.lit("{}"), "map<string,string>").alias("notes"),
    )
    shown = _visible(spark, d)
    resolved = shown.select("paper_id", F.col("id").alias("wanted"), F.col("id").alias("resolved"))
    papers = V.papers(spark, d).withColumn("source_sha256", F.lit("h"))
    got = state.imported(backups, papers, V.segments(spark, d), shown, resolved)
    return got.select(F.col("paper_id").alias("user_id"), F.col("currentSegmentId").alias("position"), F.size("seen").cast("long").alias("seen"))


@query(f"WITH {V.ACTIONS} SELECT user_id, count(DISTINCT k) AS understood FROM acts GROUP BY 1")
def mark_understood(spark, d):
    """Each reader's understood set holds every other place; the last one marked joins it once."""
    a = V.actions(spark, d)
    ids = F.collect_set(F.col("k").cast("string"))
    rows = a.groupBy("user_id").agg(ids.alias("all"), F.max_by(F.col("k").cast("string"), F.struct("ts", "event_id")).alias("currentSegmentId"))
    rows = rows.withColumn("understood", F.when(F.col("user_id") % 2 == 0, F.col("all")).otherwise(F.array_remove("all", F.col("currentSegmentId"))))
    return state.mark_understood(rows).select("user_id", F.size("understood").cast("long").alias("understood"))


@query(f"WITH {V.VISIBLE} SELECT paper_id AS paper, n AS position, id AS segment FROM (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS n FROM vis) WHERE n IN (3, 10)")
def navigate(spark, d):
    wanted = V.papers(spark, d).select("paper_id", F.explode(F.array(F.lit(3), F.lit(10))).alias("position"))
    return S.navigated(_visible(spark, d), wanted).select(F.col("paperId").alias("paper"), F.col("order").alias("position"), F.col("segmentId").alias("segment"))


# Scalar functions


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'untranslated' ELSE 'ai-draft' END AS status, CASE doc_id % 3 WHEN 0 THEN '人工校訂' WHEN 1 THEN 'AI 草稿' ELSE '待翻譯' END AS label FROM documents")
def translation_states(spark, d):
    k, m = F.col("doc_id") % 4, F.col("doc_id") % 3
    status = labels.translation_status(F.when(k.isin(0, 1), "x").otherwise(" 　"), F.when(k.isin(0, 2), "y"))
    label = labels.translation_label(F.when(m == 0, "reviewed").when(m == 1, "ai-draft"))
    return V.table(spark, d, "documents").select("doc_id", status.alias("status"), label.alias("label"))


@query("SELECT p_partkey, 'reader-state:' || p_partkey AS key FROM part")
def storage_keys(spark, d):
    return V.table(spark, d, "part").select("p_partkey", text.storage_key("reader-state:", F.col("p_partkey").cast("string")).alias("key"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'resolved' WHEN 2 THEN 'resolved' END AS notice, p_partkey % 5 <> 0 AS usable FROM part")
def doi_notices(spark, d):
    p = F.col("p_partkey")
    notice = labels.doi_notice(F.when(p % 4 == 3, "").otherwise("crossref"), F.when(p % 4 == 0, "10.1/a").when(p % 4 == 1, "10.1/b"), F.lit("10.1/b"))
    return V.table(spark, d, "part").select("p_partkey", notice.alias("notice"), labels.abstract_usable(F.when(p % 5 == 0, "title-mismatch")).alias("usable"))


@query("SELECT p_partkey, p_partkey % 5 < 3 AS is_running FROM part")
def caption_sentences(spark, d):
    p = F.col("p_partkey")
    said = F.when(p % 5 == 0, F.concat(F.lit("Table "), p, F.lit(" shows growth"))).when(p % 5 == 1, F.concat(F.lit("fig. "), p, F.lit(" Depicts it"))).when(p % 5 == 2, F.concat(F.lit("Figure "), p, F.lit(" represents all")))
    said = said.when(p % 5 == 3, F.concat(F.lit("Table "), p, F.lit(" Growth"))).otherwise(F.concat(F.lit("In Table "), p, F.lit(" shows")))
    return V.table(spark, d, "part").select("p_partkey", text.is_caption_sentence(said).alias("is_running"))


@query("SELECT p_partkey, replace(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN 'Straße' ELSE '' END), 'ß', 'ss') AS folded FROM part")
def casefold_terms(spark, d):
    return V.table(spark, d, "part").select("p_partkey", text.casefold(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "Straße").otherwise(""))).alias("folded"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS is_found FROM part")
def quoted_patterns(spark, d):
    """Names with pattern signs, searched as they are in texts that hold them or nearly do."""
    name = F.concat(F.lit("(a.b)\\E+"), "p_name")
    said = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("x "), name, F.lit("!"))).otherwise(F.concat(F.lit("(aXb)\\E+"), "p_name"))
    return V.table(spark, d, "part").select("p_partkey", F.regexp_like(said, text.regex_quoted(name)).alias("is_found"))


@query("SELECT p_partkey, p_size AS first_at, p_size + 6 + length(CAST(p_partkey AS VARCHAR)) AS ends_at, 'table' AS kind, CAST(p_partkey AS VARCHAR) AS number FROM part")
def mention_places(spark, d):
    said = F.concat(F.repeat(F.lit("a"), F.col("p_size") - 1), F.lit(" Table "), "p_partkey", F.lit(", end"))
    rows = V.table(spark, d, "part").select("p_partkey", "p_size", F.explode(text.mention_offsets(said)).alias("m"))
    return rows.select("p_partkey", F.col("m.start").alias("first_at"), F.col("m.end").alias("ends_at"), "m.kind", "m.number")


@query("SELECT p_partkey, (p_size + p_retailprice) / 2 AS x, CAST(5.0 AS DOUBLE) AS y, p_size * 3.0 AS scaled FROM part")
def box_geometry(spark, d):
    box = F.array(F.col("p_size").cast("double"), F.lit(0.0), F.col("p_retailprice"), F.lit(10.0))
    rows = V.table(spark, d, "part").select("p_partkey", geometry.centre(box).alias("c"), geometry.scaled(box, F.lit(100.0), F.lit(300.0))[0].alias("scaled"))
    return rows.select("p_partkey", "c.x", "c.y", "scaled")


# Edits


def _segments(spark, d):
    """Turns as whole segments."""
    t, s = F.col("turn"), F.struct
    tr = s(F.when(t % 3 == 0, "").otherwise(F.concat(F.lit("f"), t)).alias("faithfulZh"), F.concat(F.lit("p"), t).alias("plainZh"), F.lit("reviewed").alias("status"), F.lit("then").alias("reviewedAt"))
    return V.turns(spark, d).select(
        F.col("conv_id").alias("paper_id"), F.when(t == 5, "4-merged").when(t == 6, "1-a").otherwise(t.cast("string")).alias("id"), t.alias("order"), F.lit("sec").alias("section"), F.col("text").alias("sourceText"),
        F.array(s(t.alias("page"))).alias("fragments"), F.lit(0.9).alias("confidence"), F.when(t % 2 == 0, F.lit(True)).alias("excluded"), F.lit("reviewed").alias("reviewStatus"), tr.alias("translation"),
    )


_SEGS = "s AS (SELECT conv_id, turn, CASE turn WHEN 5 THEN '4-merged' WHEN 6 THEN '1-a' ELSE CAST(turn AS VARCHAR) END AS id, text, CASE WHEN turn % 3 = 0 THEN '' ELSE 'f' || turn END AS f, 'p' || turn AS p, CASE WHEN turn % 2 = 0 THEN true END AS e FROM conversations)"


@query(
    f"WITH {_SEGS}, x AS (SELECT *, lead(turn) OVER w AS n, lead(text) OVER w AS t2, lead(f) OVER w AS f2, lead(p) OVER w AS p2, lead(e) OVER w AS e2, lag(turn) OVER w AS b FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "y AS (SELECT *, turn % 4 = 0 AND n IS NOT NULL AS m, EXISTS (SELECT 1 FROM s WHERE s.conv_id = x.conv_id AND s.id = x.id || '-merged') AS hit FROM x WHERE b IS NULL OR b % 4 <> 0) "
    "SELECT conv_id, turn, CASE WHEN m AND hit THEN id || '-merged-2' WHEN m THEN id || '-merged' ELSE id END AS id, md5(CASE WHEN m THEN trim(text) || ' ' || trim(t2) ELSE text END) AS body, CASE WHEN m THEN 2 ELSE 1 END AS boxes, "
    "CASE WHEN m THEN CAST(0.5 AS DOUBLE) ELSE 0.9 END AS confidence, CASE WHEN m THEN coalesce(e AND e2, false) ELSE e END AS excluded, CASE WHEN m THEN concat_ws(chr(10) || chr(10), nullif(f, ''), nullif(f2, '')) ELSE f END AS faithful, "
    "CASE WHEN m THEN p || chr(10) || chr(10) || p2 ELSE p END AS plain, CASE WHEN m THEN 'ai-draft' ELSE 'reviewed' END AS status, CASE WHEN m THEN 'needs-review' ELSE 'reviewed' END AS review FROM y"
)
def merge_segments(spark, d):
    got = edits.merge_segments(_segments(spark, d), "order", F.col("order") % 4 == 0)
    tr = F.col("translation")
    return got.select(F.col("paper_id").alias("conv_id"), F.col("order").alias("turn"), "id", F.md5("sourceText").alias("body"), F.size("fragments").alias("boxes"), "confidence", "excluded", tr["faithfulZh"].alias("faithful"), tr["plainZh"].alias("plain"), tr["status"].alias("status"), F.col("reviewStatus").alias("review"))


@query(
    f"WITH {_SEGS}, x AS (SELECT *, trim(substr('𝄞' || text, 1, 19), ' ' || chr(10)) AS a, trim(substr('𝄞' || text, 20), ' ' || chr(10)) AS b, length(text) + 2 AS units FROM s), y AS (SELECT *, units > 20 AND a <> '' AND b <> '' AS cut, "
    "EXISTS (SELECT 1 FROM s WHERE s.conv_id = x.conv_id AND s.id = x.id || '-a') AS hit FROM x) "
    "SELECT conv_id, turn, id || CASE WHEN hit THEN '-a-2' ELSE '-a' END AS id, md5(a) AS body, CAST(0.45 AS DOUBLE) AS confidence, '' AS plain, 'untranslated' AS status, 'needs-review' AS review FROM y WHERE cut "
    "UNION ALL SELECT conv_id, turn, id || '-b', md5(b), 0.45, '', 'untranslated', 'needs-review' FROM y WHERE cut UNION ALL SELECT conv_id, turn, id, md5('𝄞' || text), 0.9, p, 'reviewed', 'reviewed' FROM y WHERE NOT cut"
)
def split_segments(spark, d):
    """Cut after twenty UTF-16 units; the first sign of every text takes two."""
    rows = V.dealt(_segments(spark, d)).withColumn("sourceText", F.concat(F.lit("𝄞"), "sourceText"))
    got = edits.split_segments(rows, "order", F.lit(20))
    tr = F.col("translation")
    return got.select(F.col("paper_id").alias("conv_id"), F.col("order").alias("turn"), "id", F.md5("sourceText").alias("body"), "confidence", tr["plainZh"].alias("plain"), tr["status"].alias("status"), F.col("reviewStatus").alias("review"))


def _at():
    return F.col("order") % 2 == 1


def _edited(rows):
    tr = F.col("translation")
    return rows.select(F.col("paper_id").alias("conv_id"), F.col("order").alias("turn"), F.md5("sourceText").alias("body"), "excluded", "section", tr["faithfulZh"].alias("faithful"), tr["status"].alias("status"), tr["reviewedAt"].alias("reviewed_at"), F.col("reviewStatus").alias("review"))


def _edit_sql(**new: str) -> str:
    """All edited columns; new values hold for odd turns."""
    old = {"body": "md5(text)", "excluded": "e", "section": "'sec'", "faithful": "f", "status": "'reviewed'", "reviewed_at": "'then'", "review": "'reviewed'"}
    columns = ", ".join(f"CASE WHEN turn % 2 = 1 THEN {new[k]} ELSE {v} END AS {k}" if k in new else f"{v} AS {k}" for k, v in old.items())
    return f"WITH {_SEGS} SELECT conv_id, turn, {columns} FROM s"


@query(_edit_sql(excluded="NOT coalesce(e, false)", review="'needs-review'"))
def toggle_exclusion(spark, d):
    return _edited(edits.toggled_exclusion(_segments(spark, d), _at()))


@query(_edit_sql(body="md5(text || '!')", status="'ai-draft'", reviewed_at="NULL", review="'needs-review'"))
def edit_source_text(spark, d):
    return _edited(edits.with_source_text(_segments(spark, d), _at(), F.concat("sourceText", F.lit("!"))))


@query(_edit_sql(faithful="'new'", status="'ai-draft'", reviewed_at="NULL", review="'needs-review'"))
def edit_translation(spark, d):
    return _edited(edits.with_translation(_segments(spark, d), _at(), "faithfulZh", F.lit("new")))


@query(_edit_sql(reviewed_at="CASE WHEN f <> '' THEN 'now' ELSE 'then' END"))
def mark_reviewed(spark, d):
    return _edited(edits.reviewed(_segments(spark, d), _at(), F.lit("now")))


@query(_edit_sql(section="'sec ' || turn", review="'needs-review'"))
def edit_section(spark, d):
    return _edited(edits.with_section(_segments(spark, d), _at(), F.concat(F.lit("sec "), "order")))


@query("SELECT doc_id, 'draft' AS status, true AS is_stamped FROM documents")
def draft_documents(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.lit("published").alias("publicationStatus"), F.lit("").alias("generatedAt"))
    return edits.edited(rows).select("doc_id", F.col("publicationStatus").alias("status"), F.col("generatedAt").rlike(r"^\d{4}-\d\d-\d\dT").alias("is_stamped"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (1, 7)")
def discard_edits(spark, d):
    return edits.reverted(V.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id")), [1, 7]).select(F.col("paper_id").alias("doc_id"))


# Merges


@query(
    "WITH x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Table ' || c_custkey || ' shows growth' ELSE c_name END AS t, c_custkey % 5 <> 0 AS same, c_custkey % 6 <> 0 AS boxes, c_custkey % 7 <> 0 AS draft FROM customer) "
    "SELECT id, CASE WHEN same AND draft AND id % 2 = 0 THEN 'body' ELSE 'caption' END AS kind, CASE WHEN id % 3 = 0 AND boxes AND draft THEN 'new' ELSE 'old' END AS section, CASE WHEN id % 4 = 1 AND draft THEN 'better' ELSE 'p' || (id % 4) END AS plain, "
    "CASE WHEN same AND boxes THEN 'm' || id END AS mentions, CASE WHEN same THEN 'f' END AS assessment, CASE WHEN id % 11 = 0 THEN 1 WHEN id % 13 = 0 AND same THEN 2 END AS merged, CASE WHEN id % 2 = 1 THEN 's' ELSE 'n' END AS exhibits FROM x"
)
def repaired_fields(spark, d):
    """Field merges with explanation and section repairs, captions that are running text, boxes that moved, reviewed rows."""
    c, i = V.table(spark, d, "customer"), F.col("c_custkey")
    own = F.when(i % 2 == 0, F.concat(F.lit("Table "), i, F.lit(" shows growth"))).otherwise(F.col("c_name"))
    tr = lambda plain: F.struct(F.lit("ai-draft").alias("status"), plain.alias("plainZh"))
    old = tr(F.concat(F.lit("p"), i % 4))
    key = [_one(), i.alias("id")]
    stored = c.select(
        *key, own.alias("sourceText"), F.lit("caption").alias("kind"), F.lit("old").alias("section"), old.alias("translation"), F.when(i % 7 == 0, "reviewed").otherwise("needs-review").alias("reviewStatus"), F.lit("w").alias("exhibitMentions"),
        F.lit("w").alias("paragraphAssessment"), F.lit(1).alias("fragments"), F.when(i % 11 == 0, F.lit(1)).alias("mergedIntoSegmentId"), F.lit("s").alias("exhibitIds"),
    )
    source = c.select(
        *key, F.when(i % 5 == 0, "other").otherwise(own).alias("sourceText"), F.lit("body").alias("kind"), F.lit("new").alias("section"), tr(F.lit("better")).alias("translation"), F.concat(F.lit("m"), i).alias("exhibitMentions"),
        F.lit("f").alias("paragraphAssessment"), F.when(i % 6 == 0, 2).otherwise(1).alias("fragments"), F.when(i % 13 == 0, F.lit(2)).alias("mergedIntoSegmentId"), F.when(i % 2 == 0, "n").alias("exhibitIds"),
    )
    explained = c.filter("c_custkey % 4 = 1").select(*key, own.alias("sourceText"), old.alias("previousTranslation"))
    sections = c.filter("c_custkey % 3 = 0").select(*key, own.alias("sourceText"), F.lit("old").alias("previousSection"), F.lit("new").alias("section"))
    got = merge.field_merge(stored, source, None, explained, sections)
    return got.select("id", "kind", "section", F.col("translation.plainZh").alias("plain"), F.col("exhibitMentions").alias("mentions"), F.col("paragraphAssessment").alias("assessment"), F.col("mergedIntoSegmentId").alias("merged"), F.col("exhibitIds").alias("exhibits"))


@query(
    "WITH x AS (SELECT conv_id, turn, text, conv_id % 2 = 0 AS already, conv_id % 3 <> 0 AS untouched FROM conversations) SELECT conv_id, turn, md5(CASE WHEN turn = 0 AND NOT already AND untouched THEN text || ' new' ELSE text END) AS body, "
    "CASE WHEN turn = 1 AND (already OR untouched) AND EXISTS (SELECT 1 FROM conversations z WHERE z.conv_id = x.conv_id AND z.turn = 0) THEN '0' END AS merged, CASE WHEN turn = 1 AND (already OR untouched) AND EXISTS (SELECT 1 FROM conversations z WHERE z.conv_id = x.conv_id AND z.turn = 0) THEN true END AS excluded FROM x"
)
def repaired_units(spark, d):
    """In every conversation a repair replaces turn 0 and absorbs turn 1, unless the reader's text differs from both versions."""
    t, c = F.col("turn"), F.col("conv_id")
    seg = lambda body: (c.alias("paper_id"), t.cast("string").alias("id"), t.alias("order"), body.alias("sourceText"), F.array(F.lit(1)).alias("fragments"), F.lit("tr").alias("translation"), F.lit("needs-review").alias("reviewStatus"), F.lit(None).cast("boolean").alias("excluded"), F.lit(None).cast("string").alias("mergedIntoSegmentId"))
    rows = V.turns(spark, d)
    stored = rows.select(*seg(F.col("text")))
    source = rows.select(*seg(F.when((t == 0) & (c % 2 == 1), F.concat("text", F.lit(" new"))).otherwise(F.col("text"))))
    before = F.struct(F.lit("0").alias("id"), F.when(c % 3 != 0, F.col("text")).otherwise("mine").alias("sourceText"), F.array(F.lit(1)).alias("fragments"), F.lit("tr").alias("translation"))
    repairs = rows.filter("turn = 0").select(c.alias("paper_id"), F.lit(0).alias("position"), F.lit("0").alias("targetId"), F.array(before).alias("previousSegments"), F.array(F.lit("1")).alias("absorbedIds"))
    got, _ = merge.unit_repairs(stored, source, repairs)
    return got.select(F.col("paper_id").alias("conv_id"), F.col("order").alias("turn"), F.md5("sourceText").alias("body"), F.col("mergedIntoSegmentId").alias("merged"), "excluded")


#: Repairs of a conversation follow each other: 0 replaces turn 0 and absorbs 1; 1 asks what 0 made of turn 0, replaces turn 2
#: and absorbs 0; 2 asks for turn 2 as it was, which 1 may have replaced, or for
#: another text, and absorbs 3.
_CHAIN = """WITH x AS (SELECT conv_id, turn, text, conv_id % 3 <> 0 AS u0, conv_id % 5 <> 0 AS u2 FROM conversations),
  h AS (SELECT conv_id, bool_or(turn = 0) AS t0, bool_or(turn = 2) AS t2 FROM x GROUP BY 1),
  r AS (SELECT h.*, conv_id % 3 <> 0 AS d0, t2 AND t0 AND conv_id % 3 <> 0 AND conv_id % 5 <> 0 AS d1, t2 AND ((t0 AND conv_id % 3 <> 0 AND conv_id % 5 <> 0) OR conv_id % 7 <> 0) AS d2 FROM h)
  SELECT x.conv_id, x.turn, md5(CASE WHEN x.turn = 0 AND d0 THEN text || ' new' WHEN x.turn = 2 AND d2 THEN text || ' new' ELSE text END) AS body,
    CASE WHEN x.turn = 1 AND t0 AND d0 THEN '0' WHEN x.turn = 0 AND d1 THEN '2' WHEN x.turn = 3 AND d2 THEN '2' END AS merged,
    CASE WHEN x.turn = 1 AND t0 AND d0 THEN true WHEN x.turn = 0 AND d1 THEN true WHEN x.turn = 3 AND d2 THEN true END AS excluded FROM x JOIN r ON r.conv_id = x.conv_id"""


@query(_CHAIN)
def chained_repairs(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    seg = lambda body: (c.alias("paper_id"), t.cast("string").alias("id"), t.alias("order"), body.alias("sourceText"), F.lit("tr").alias("translation"), F.array(F.lit(1)).alias("fragments"), F.lit("needs-review").alias("reviewStatus"), F.lit(None).cast("boolean").alias("excluded"), F.lit(None).cast("string").alias("mergedIntoSegmentId"))
    rows = V.turns(spark, d)
    new = F.concat("text", F.lit(" new"))
    stored, source = rows.select(*seg(F.col("text"))), rows.select(*seg(F.when(t.isin(0, 2), new).otherwise(F.col("text"))))
    was = lambda i, body: F.struct(F.lit(i).alias("id"), body.alias("sourceText"), F.array(F.lit(1)).alias("fragments"), F.lit("tr").alias("translation"))
    repair = lambda position, target, before, absorbed: F.struct(F.lit(position).alias("position"), F.lit(target).alias("targetId"), before.alias("previousSegments"), absorbed.alias("absorbedIds"))
    text = rows.groupBy("conv_id").agg(F.max(F.when(t == 0, F.col("text"))).alias("t0"), F.max(F.when(t == 2, F.col("text"))).alias("t2"))
    t0, t2 = F.coalesce("t0", F.lit("")), F.coalesce("t2", F.lit(""))
    steps = F.array(
        repair(0, "0", F.array(was("0", F.when(c % 3 != 0, t0).otherwise("mine"))), F.array(F.lit("1"))),
        repair(1, "2", F.array(was("0", F.concat(t0, F.lit(" new"))), was("2", F.when(c % 5 != 0, t2).otherwise("mine"))), F.array(F.lit("0"))),
        repair(2, "2", F.array(was("2", F.when(c % 7 != 0, t2).otherwise("mine"))), F.array(F.lit("3"))),
    )
    repairs = text.select(c.alias("paper_id"), F.explode(steps).alias("r")).select("paper_id", "r.*")
    got, _ = merge.unit_repairs(stored, source, repairs)
    return got.select(F.col("paper_id").alias("conv_id"), F.col("order").alias("turn"), F.md5("sourceText").alias("body"), F.col("mergedIntoSegmentId").alias("merged"), "excluded")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'mine ' || source ELSE source END AS title, 'published ' || lang AS citations FROM documents")
def source_fields(spark, d):
    """Documents edited by readers keep their title, but not their citations."""
    docs = V.table(spark, d, "documents")
    source = docs.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.concat(F.lit("published "), "lang").alias("citations"))
    stored = source.filter("paper_id % 3 = 0").select("paper_id", F.concat(F.lit("mine "), "title").alias("title"), F.lit("old").alias("citations"))
    segs = docs.select(F.col("doc_id").alias("paper_id"), F.lit("1").alias("id"), F.lit(1).alias("order"), F.lit("t").alias("sourceText"))
    got, own = merge.reconcile_documents(stored, source, segs.filter("paper_id % 3 = 0"), segs)
    return got.join(own.select("paper_id").distinct(), "paper_id", "left_semi").select(F.col("paper_id").alias("doc_id"), "title", "citations")


# Views. A user is the reader of the paper of the same number; what he did last with a segment corrects its link.

_LINKED = """links AS (SELECT paper_id, id, 'e' || paper_id AS exhibit, CASE WHEN ord % 8 = 2 THEN 'high' ELSE 'candidate' END AS confidence FROM segs
    WHERE ord % 2 = 0 AND ord % 5 <> 0 AND paper_id % 3 = 0),
  x AS (SELECT doc_id AS paper_id, 'e' || doc_id AS exhibit FROM documents WHERE doc_id % 3 = 0 AND len(string_split(text, chr(10))) >= 3)"""
_DONE = """done AS (SELECT user_id AS paper_id, user_id || '-' || (k + 1) AS id, bool_or(event_type = 'view') AS seen, bool_or(event_type = 'signup') AS bookmarked,
    arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS note, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('click', 'error')) AS act FROM acts GROUP BY 1, 2)"""


def _view_parts(spark, d):
    docs = V.labelled(spark, d)
    segs = V.segments(spark, d, docs)
    o = F.col("order")
    links = segs.filter((o % 2 == 0) & (F.col("paper_id") % 3 == 0)).select(
        "paper_id", F.col("id").alias("segmentId"), F.concat(F.lit("e"), "paper_id").alias("exhibitId"), F.lit("semantic").alias("method"), F.when(o % 8 == 2, "high").otherwise("candidate").alias("confidence"),
        F.lit("").alias("relationshipZh"), F.when(o % 5 == 0, "gone").otherwise(F.col("sourceText")).alias("evidenceQuote"),
    )
    exhibits = V.exhibits(spark, d, docs).withColumn("label", F.concat(F.lit("Figure "), "paper_id"))
    return docs, segs.withColumn("mergedIntoSegmentId", F.when(o % 9 == 8, F.concat("paper_id", F.lit("-"), o - 1))), links, exhibits


@query(
    f"WITH {V.VISIBLE}, {V.ACTIONS}, {_DONE}, {_LINKED}, "
    "c AS (SELECT paper_id, id, act, 1 AS own, CAST(split_part(id, '-', 2) AS BIGINT) AS n FROM done WHERE act IS NOT NULL UNION ALL SELECT paper_id, paper_id || '-' || (CAST(split_part(id, '-', 2) AS BIGINT) - 1), act, 0, CAST(split_part(id, '-', 2) AS BIGINT) FROM done WHERE act IS NOT NULL AND CAST(split_part(id, '-', 2) AS BIGINT) % 9 = 8 AND (paper_id, id) IN (SELECT (paper_id, id) FROM segs)), "
    "e AS (SELECT paper_id, id, arg_max(act, (own, n)) AS act FROM c WHERE own = 0 OR (paper_id, id) IN (SELECT (paper_id, id) FROM segs) GROUP BY 1, 2), "
    "a AS (SELECT s.paper_id, s.id, l.confidence, e.act, CASE WHEN coalesce(e.act, '') = 'error' THEN NULL WHEN l.confidence = 'high' OR e.act = 'click' THEN 'accepted' WHEN l.confidence = 'candidate' AND e.act IS NULL THEN 'candidate' END AS status, x.exhibit "
    "FROM segs s LEFT JOIN links l ON l.paper_id = s.paper_id AND l.id = s.id LEFT JOIN e ON e.paper_id = s.paper_id AND e.id = s.id LEFT JOIN x ON x.paper_id = s.paper_id WHERE l.id IS NOT NULL OR (e.act = 'click' AND x.exhibit IS NOT NULL)), "
    "t AS (SELECT paper_id, id, exhibit IS NOT NULL AND coalesce(status = 'accepted', false) AS accepted, coalesce(status = 'candidate', false) AS candidate FROM a), "
    "v AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY paper_id) AS total, coalesce(lag(id) OVER w, id) AS previous, coalesce(lead(id) OVER w, id) AS next FROM vis WINDOW w AS (PARTITION BY paper_id ORDER BY ord)) "
    "SELECT v.paper_id, v.id, CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS place, total, previous, next, kind, md5(\"sourceText\") AS body, CAST(coalesce(accepted, false) AS BIGINT) AS accepted, CAST(coalesce(candidate, false) AS BIGINT) AS candidates, "
    "CASE WHEN accepted THEN 'Figure ' || v.paper_id ELSE '' END AS labels, coalesce(seen, false) AS seen, coalesce(bookmarked, false) AS bookmarked, note FROM v LEFT JOIN t ON t.paper_id = v.paper_id AND t.id = v.id LEFT JOIN done ON done.paper_id = v.paper_id AND done.id = v.id"
)
def reader_view(spark, d):
    docs, segs, links, exhibits = _view_parts(spark, d)
    kind = F.col("event_type")
    at = F.struct("ts", "event_id")
    corrected = F.max_by(F.when(kind == "click", "include").otherwise("exclude"), F.when(kind.isin("click", "error"), at))
    done = V.actions(spark, d).groupBy(F.col("user_id").alias("paper_id"), F.concat("user_id", F.lit("-"), F.col("k") + 1).alias("id")).agg(
        (F.count_if(kind == "view") > 0).alias("seen"), (F.count_if(kind == "signup") > 0).alias("bookmarked"), F.max_by("event_id", F.when(kind == "purchase", at)).alias("note"),
        F.when(F.count_if(kind.isin("click", "error")) > 0, corrected).alias("act"), F.count_if(kind == "purchase").alias("noted"),
    )
    marks = done.select("paper_id", "id", "seen", "bookmarked", F.when(F.col("noted") > 0, F.col("note")).alias("note"), F.when(F.col("act").isNotNull(), F.create_map(F.concat(F.lit("e"), "paper_id"), F.col("act"))).alias("corrections"))
    got = views.reader_view(segs, V.papers(spark, d, docs), exhibits, links, marks)
    return got.withColumn("labels", F.array_join("labels", ",")).withColumn("body", F.md5("sourceText")).drop("sourceText")


@query(
    f"WITH {V.SEGMENTS}, {_LINKED}, p AS (SELECT paper_id, count(*) FILTER (NOT coalesce(excluded, false)) AS included, count(*) FILTER (coalesce(excluded, false)) AS excluded_count, count(*) FILTER (NOT coalesce(excluded, false) AND review = 'reviewed') AS reviewed FROM segs GROUP BY 1) "
    "SELECT s.paper_id, s.id, s.ord, s.kind, coalesce(s.excluded, false) AS excluded, s.review, s.translation, md5(CASE WHEN s.ord % 4 = 3 THEN s.\"sourceText\" || '!' ELSE s.\"sourceText\" END) AS body, s.ord % 4 = 3 AS edited, "
    "CAST(m.id IS NOT NULL AND m.kind <> 'heading' AND m.ord % 9 = 8 AS BIGINT) AS absorbed, CAST(coalesce(l.confidence = 'high', false) AND x.exhibit IS NOT NULL AS BIGINT) AS accepted, CAST(coalesce(l.confidence = 'candidate', false) AS BIGINT) AS candidates, included, excluded_count, reviewed "
    "FROM segs s JOIN p ON p.paper_id = s.paper_id LEFT JOIN segs m ON m.paper_id = s.paper_id AND m.ord = s.ord + 1 LEFT JOIN links l ON l.paper_id = s.paper_id AND l.id = s.id LEFT JOIN x ON x.paper_id = s.paper_id"
)
def editor_view(spark, d):
    _, segs, links, exhibits = _view_parts(spark, d)
    changed = segs.filter(F.col("order") % 4 == 3).select("paper_id", "id", F.concat("sourceText", F.lit("!")).alias("sourceText"))
    got = views.editor_view(segs, links, exhibits, changed)
    return got.withColumn("body", F.md5("sourceText")).drop("sourceText").withColumnsRenamed({"order": "ord", "reviewStatus": "review", "translationStatus": "translation"})


@query(
    "SELECT doc_id AS id, CASE doc_id % 11 WHEN 1 THEN 'identity' WHEN 2 THEN 'segments' WHEN 3 THEN 'segments.included' WHEN 4 THEN 'segment.id' WHEN 5 THEN 'segment.id' WHEN 6 THEN 'segment.text' WHEN 7 THEN 'segment.fragments' "
    "WHEN 8 THEN 'segment.translation' WHEN 9 THEN 'segment.reviewed' WHEN 10 THEN 'segment.fragments' END AS error FROM documents"
)
def dq_segments(spark, d):
    """Documents of two segments, ten of eleven of which break a rule: wrong hash, no segments, all excluded, an id twice,
    a blank id, a blank text, a box beyond its page, an unknown state, reviewed without a text, no boxes."""
    k = F.col("doc_id") % 11
    box = F.struct(F.lit(1).alias("page"), F.array(F.lit(0.0), F.lit(0.0), F.when(k == 7, 2.0).otherwise(1.0), F.lit(1.0)).alias("bbox"), F.array(F.lit(1.0), F.lit(1.0)).alias("pageSize"))
    tr = F.struct(F.when(k == 8, "done").when((k == 9) | (k == 0), "reviewed").otherwise("ai-draft").alias("status"), F.lit("f").alias("faithfulZh"), F.when(k == 9, " \n").otherwise("p").alias("plainZh"))
    seg = lambda i, body: F.struct(i.alias("id"), F.lit(1).cast("long").alias("order"), body.alias("sourceText"), (k == 3).alias("excluded"), F.when(k != 10, F.array(box)).alias("fragments"), tr.alias("translation"))
    both = F.array(seg(F.lit("a"), F.lit("one")), seg(F.when(k == 4, "a").when(k == 5, " ").otherwise("b"), F.when(k == 6, "　").otherwise("two")))
    docs = V.table(spark, d, "documents")
    stored = docs.select(F.col("doc_id").alias("id"), F.when(k == 2, F.filter(both, lambda s: F.lit(False))).otherwise(both).alias("segments"), F.lit("1").alias("schemaVersion"), F.when(k == 1, "other").otherwise("sha").alias("sourceSha256"))
    source = docs.select(F.col("doc_id").alias("id"), F.lit("1").alias("schemaVersion"), F.lit("sha").alias("sourceSha256"), F.lit(1).alias("pageCount"))
    return quality.curated_document(stored, source).select("id", "error")


@query("SELECT conv_id, count(*) FILTER (turn % 2 = 0) + CAST(count(*) FILTER (turn % 2 = 0 AND turn = 1) = 0 AS BIGINT) AS entries, coalesce(max(CASE WHEN turn = 0 THEN md5(text) END), '') AS first_note, 'kept' AS put_note FROM conversations GROUP BY 1")
def put_notes(spark, d):
    """Notes of even turns; then one is put where there is none, and one over another."""
    entry = F.struct(F.col("turn").cast("string"), F.md5("text"))
    notes = V.turns(spark, d).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("turn") % 2 == 0, entry))).alias("notes"))
    put = state.put(state.put(F.col("notes"), F.lit("1"), F.lit("draft")), F.lit("1"), F.lit("kept"))
    rows = notes.withColumn("notes", put)
    return rows.select("conv_id", F.size("notes").cast("long").alias("entries"), F.coalesce(F.try_element_at("notes", F.lit("0")), F.lit("")).alias("first_note"), F.try_element_at("notes", F.lit("1")).alias("put_note"))
