"""Operators on hand-made rows, with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import geometry, labels, text
from glossa.operators import edits, links, merge, quality, segments, state, study
from glossa.sources import corpus_json, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def segs(spark, rows):
    names = "paper_id string, id string, `order` int, kind string, excluded boolean, readingRole string, mergedIntoSegmentId string, sourceText string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def paper(spark):
    rows = [
        ("p", "s1", 1, "heading", None, None, None, "Title"), ("p", "s2", 2, "body", False, None, None, "Alpha"), ("p", "s3", 3, "caption", None, None, None, "Table 1"),
        ("p", "s4", 4, "body", True, None, None, "Gone"), ("p", "s5", 5, "body", True, None, "s6", "Part"), ("p", "s6", 6, "body", None, None, None, "Whole"),
        ("p", "s7", 7, "body", None, "note", None, "Role"), ("p", "s8", 8, "body", None, "", None, "End"),
    ]
    s = segs(spark, rows)
    papers = spark.createDataFrame([("p", True, True)], "paper_id string, has_quality boolean, has_companion boolean")
    ex = spark.createDataFrame([("p", "e1", "s3", 0)], "paper_id string, id string, captionSegmentId string, position int")
    li = spark.createDataFrame(
        [("p", "s2", "e1", "explicit", "high", "r", "Alpha", 0), ("p", "s6", "e1", "semantic", "candidate", "c", "Whole", 1), ("p", "s8", "e1", "explicit", "high", "r", "old text", 2)],
        "paper_id string, segmentId string, exhibitId string, method string, confidence string, relationshipZh string, evidenceQuote string, position int",
    )
    return s, papers, ex, li


def test_visible_and_resolve(spark, paper):
    s, papers, ex, li = paper
    shown = segments.visible(s, papers, ex)
    assert [r.id for r in shown.orderBy("order").collect()] == ["s1", "s2", "s6", "s8"]
    wanted = spark.createDataFrame([("p", i) for i in ("s2", "s5", "s3", "s4", "s7", "zz")], "paper_id string, wanted string")
    got = {r.wanted: r.resolved for r in segments.resolve(wanted, s, shown, ex, li, papers).collect()}
    assert got == {"s2": "s2", "s5": "s6", "s3": "s2", "s4": "s6", "s7": "s8", "zz": "s1"}


def test_links_and_overview(spark, paper):
    s, papers, ex, li = paper
    own = spark.createDataFrame([("p", "s5", "e1", "include"), ("p", "s2", "e1", "exclude"), ("p", "s8", "e1", "include"), ("p", "s8", "e9", "include")], "paper_id string, segment_id string, exhibit_id string, action string")
    eff = links.effective_corrections(own, s)
    got = {(r.segmentId, r.exhibitId): (r.status, r.confidence, r.relationshipZh) for r in links.resolve_links(li, eff, s, ex).collect()}
    assert got[("s6", "e1")] == ("accepted", "high", links.CONFIRMED + "c")
    assert got[("s8", "e1")] == ("accepted", "high", links.ADDED)
    assert ("s2", "e1") not in got and ("s8", "e9") not in got
    shown = segments.visible(s, papers, ex)
    over = links.exhibit_overview(links.resolve_links(li, eff, s, ex), shown, own)
    assert {(r.segment_id, r.label) for r in over.collect()} == {("s6", "semantic"), ("s8", "added")}


def test_texts(spark):
    c = F.lit
    assert one(spark, text.trim_script(c("﻿　 a b \u00a0"))) == "a b"
    assert one(spark, text.html_escape(c("<a href=\"x\">&'"))) == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, text.script_safe(c("</a>&\u2028"))) == "\\u003c/a\\u003e\\u0026\\u2028"
    got = one(spark, text.mentions(c("See Table 3, figs. 12 and 表 4")))
    assert [(m.kind, m.number) for m in got] == [("table", "3"), ("figure", "12"), ("table", "4")]
    assert one(spark, text.padded(c(1234), 3)) == "1234" and one(spark, text.padded(c(7), 3)) == "007"
    assert one(spark, text.https_url(c("https://a.b/c"))) and one(spark, text.https_url(c("http://a.b"))) is None and one(spark, text.https_url(c("::"))) is None
    assert one(spark, text.slug(c("Ünï cödé — 標題!"))) == "U-ni-co-de-標題" and one(spark, text.slug(c("!!"))) == "paper-notes"
    assert one(spark, text.casefold(c("Straße"))) == "strasse"
    assert tuple(one(spark, text.route(c("#paper=3")))) == ("guide", "paper-03") and tuple(one(spark, text.route(c("")))) == ("library", "")
    assert one(spark, F.regexp_like(c("a.b"), text.regex_quoted(c("a.b")))) and not one(spark, F.regexp_like(c("axb"), text.regex_quoted(c("a.b"))))
    assert one(spark, text.mention_offsets(c("x Fig. 2")))[0].start == 2
    assert one(spark, labels.relationship(c(""), c(None), c("ctx"), c(""), c("f"))) == "f"
    assert one(spark, geometry.percent(c(1), c(8))) == 13 and one(spark, geometry.percent(c(0), c(0))) == 0


def test_state(spark):
    xs = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, state.toggle(state.toggle(xs, F.lit("c")), F.lit("c"))) == ["a", "b"]
    assert one(spark, state.add(xs, F.lit("a"))) == ["a", "b"] and one(spark, state.toggle(xs, F.lit("a"))) == ["b"]
    m = F.create_map(F.lit("k"), F.lit("1"))
    assert one(spark, state.put(m, F.lit("k"), F.lit("2"))) == {"k": "2"}
    cs = F.from_json(F.lit('{"s":{"e":"include"}}'), "map<string,map<string,string>>")
    assert one(spark, state.correct(cs, F.lit("s"), F.lit("e"), F.lit(None).cast("string"))) == {"s": {}}
    assert one(spark, state.correct(cs, F.lit("t"), F.lit("e"), F.lit("exclude"))) == {"s": {"e": "include"}, "t": {"e": "exclude"}}


def test_edits(spark):
    rows = spark.createDataFrame([("p", 1, "a", " x ", 0.9), ("p", 2, "b", "y", 0.4), ("p", 3, "c", "z", 0.9)], "paper string, o int, id string, text string, confidence double")
    got = [(r.id, r.text, r.confidence) for r in edits.merge_with_next(rows, ["paper"], "o", F.col("o") >= 1).orderBy("o").collect()]
    assert got == [("a-merged", "x y", 0.4), ("c", "z", 0.9)]
    cut = edits.split_at(rows.filter("o = 1").withColumn("text", F.lit("left right")), ["paper"], "o", F.lit(5))
    assert sorted((r.id, r.text) for r in cut.collect()) == [("a-a", "left"), ("a-b", "right")]
    assert one(spark, edits.utf16_prefix(F.lit("a𝄞b"), F.lit(3))) == 2
    taken = spark.createDataFrame([("p", "a"), ("p", "a-2"), ("p", "a-4")], "paper_id string, id string")
    wanted = spark.createDataFrame([("p", "a"), ("p", "z")], "paper_id string, base string")
    assert {r.base: r.id for r in edits.unique_ids(wanted, taken).collect()} == {"a": "a-3", "z": "z"}
    assert [r.id for r in edits.swapped(rows, "o", 1).orderBy("o").collect()] == ["b", "a", "c"]


def test_order_repair_equals_a_loop(spark):
    rng = random.Random(5)
    stored, source, previous, expected = [], [], [], {}
    for p in range(40):
        ids = rng.sample(range(30), 12)
        src = rng.sample(ids, 9)
        sto = rng.sample(ids, rng.randint(0, 9))
        prev = list(sto) if rng.random() < 0.3 else rng.sample(ids, 4)
        out = list(sto)
        if sto == prev:
            out = list(src)
        else:
            for k, s in enumerate(src):
                if s in sto or s in prev:
                    continue
                later = [out.index(x) for x in src[k + 1 :] if x in sto]
                out.insert(min(later) if later else len(out), s)
        if not sto:
            continue
        expected[str(p)] = [str(x) for x in out]
        stored += [(str(p), str(x), k + 1) for k, x in enumerate(sto)]
        source += [(str(p), str(x), k + 1) for k, x in enumerate(src)]
        previous.append((str(p), [str(x) for x in prev]))
    schema = "paper_id string, id string, `order` int"
    got = merge.order_repair(spark.createDataFrame(stored, schema), spark.createDataFrame(source, schema), spark.createDataFrame(previous, "paper_id string, previous_ids array<string>"))
    have = {}
    for r in got.orderBy("paper_id", "order").collect():
        have.setdefault(r.paper_id, []).append(r.id)
    assert have == expected


def test_unit_repairs(spark):
    schema = "paper_id string, id string, sourceText string, fragments array<int>, translation string, reviewStatus string, excluded boolean, mergedIntoSegmentId string"
    stored = spark.createDataFrame([("p", "a", "old", [1], "t", None, None, None), ("p", "b", "rest", [1], "t", None, None, None), ("q", "a", "mine", [1], "t", None, None, None)], schema)
    source = spark.createDataFrame([("p", "a", "new", [1, 2], "t", None, None, None), ("q", "a", "new", [1], "t", None, None, None)], schema)
    prev = "paper_id string, position int, targetId string, previousSegments array<struct<id:string,sourceText:string,fragments:array<int>,translation:string>>, absorbedIds array<string>"
    repairs = spark.createDataFrame([("p", 0, "a", [("a", "old", [1], "t")], ["b"]), ("q", 0, "a", [("a", "old", [1], "t")], ["b"])], prev)
    rows, marks = merge.unit_repairs(stored, source, repairs)
    got = {(r.paper_id, r.id): (r.sourceText, r.mergedIntoSegmentId, r.excluded) for r in rows.collect()}
    assert got == {("p", "a"): ("new", None, None), ("p", "b"): ("rest", "a", True), ("q", "a"): ("mine", None, None)}
    assert {(r.paper_id, r.id, r.status) for r in marks.collect()} == {("q", "a", "pending"), ("q", "b", "protected")}


PAGE = {
    "page_title": " P & Q ", "title": "T", "subtitle": "S", "source_note": "N", "mermaid": "flowchart LR\n A1[x] --> B2(y)",
    "node_details": {k: {"title": k, "summary": "s", "explanation": "e", "page": "1", "color": "#abcdef"} for k in ("A1", "B2")},
    "statistics": [], "glossary": [{"term": "CT", "full_name": "f", "explanation": "e", "page": "1", "color": "#315F91"}],
    "discussions": [{"title": f"d{k}", "question": "q", "blocks": [{"type": "bullets", "items": [" a ", "b</script>"]}], "page": "2"} for k in range(4)],
    "easy_read": {"intro": "i", "sections": [{"title": "one", "blocks": [{"type": "table", "headers": ["h", "i"], "rows": [["1", "2"]]}]}]},
}


def page(spark, tmp_path, **change):
    import copy
    import json
    import uuid

    p = copy.deepcopy(PAGE)
    p.update(change)
    f = tmp_path / f"{uuid.uuid4().hex}.json"
    f.write_text(json.dumps(p, ensure_ascii=False))
    return corpus_json.study_pages(spark, str(f))


def test_study_page(spark, tmp_path):
    good = page(spark, tmp_path)
    assert quality.study_page(good).first().error is None
    assert tuple(study.summary(good).first()) == (2, 0, 1, 4, 1)
    template = "<!doctype html><html>" + " ".join(study.TOKENS) + "</html>"
    html = study.render(good, template).select("html", study.rendered_ok(F.col("html")).alias("ok")).first()
    assert html.ok and "P &amp; Q" in html.html and '"items":["a","b\\u003c/script\\u003e"]' in html.html and "#ABCDEF" in html.html
    assert study.statistic_cards(good).first().is_placeholder and study.contents(good).first().anchor == "easy-read-1"
    assert [r.number for r in study.discussion_cards(good).orderBy("number").collect()] == [1, 2, 3, 4]
    with pytest.raises(quality.InvalidInput):
        study.render(good, "<html></html>")


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"page_title": "  "}, "page_title"), ({"title": "x" * 501}, "title"), ({"mermaid": "pie A1[x] B2(y)"}, "mermaid.declaration"), ({"mermaid": "graph TD\n%% {init}\nA1[x] B2(y)"}, "mermaid.directive"),
        ({"node_details": {"1A": PAGE["node_details"]["A1"]}}, "node_details.id"), ({"mermaid": "flowchart LR\n A1[x]"}, "node_details.declaration"),
        ({"node_details": {"A1": PAGE["node_details"]["A1"] | {"color": "#12345"}}}, "node_details.fields"), ({"glossary": [PAGE["glossary"][0], PAGE["glossary"][0] | {"term": "ct"}]}, "glossary.duplicate"),
        ({"discussions": PAGE["discussions"][:3]}, "discussions"), ({"discussions": [*PAGE["discussions"], *PAGE["discussions"][:2]]}, "discussions"),
        ({"easy_read": {"intro": "i", "sections": [{"title": "t", "blocks": [{"type": "video", "text": "x"}]}]}}, "easy_read.fields"),
        ({"easy_read": {"intro": "i", "sections": [{"title": "t", "blocks": [{"type": "table", "headers": ["h"], "rows": [["1"]]}]}]}}, "easy_read.fields"),
        ({"easy_read": {"intro": "i", "sections": [{"title": "t", "blocks": [{"type": "table", "headers": ["h", "i"], "rows": [["1"]]}]}]}}, "easy_read.fields"),
        ({"easy_read": {"intro": "i", "sections": [{"title": "t", "blocks": [{"type": "note", "text": "x" * 21000}]}]}}, "easy_read.fields"),
    ],
)
def test_study_page_errors(spark, tmp_path, change, error):
    assert quality.study_page(page(spark, tmp_path, **change)).first().error == error


def test_companion_state(spark):
    from glossa import schema

    docs = spark.createDataFrame([("p", "h", ["s"], ["e"])], "paper_id string, sourceSha256 string, segment_ids array<string>, exhibit_ids array<string>")
    base = {"version": 1, "paperId": "p", "sourceSha256": "h", "layout": ("source", 300.0, 200.0, 0.0, 0.0, 150.0), "zooms": {"e": 1.0}, "corrections": {"s": {"e": "include"}}}
    for change, error in (({}, None), ({"version": 2}, "identity"), ({"zooms": {"e": 9.0}}, "zooms"), ({"corrections": {"x": {"e": "include"}}}, "corrections.segment"), ({"corrections": {"s": {"e": "maybe"}}}, "corrections.action"), ({"layout": ("top", 300.0, 200.0, 0.0, 0.0, 150.0)}, "layout.dock")):
        rows = spark.createDataFrame([tuple((base | change)[f] for f in schema.companion_state().fieldNames())], schema.companion_state())
        assert quality.companion_state(rows, docs).first().error == error


def test_sources_and_sinks(spark, tmp_path):
    import json

    f = tmp_path / "manifest.json"
    f.write_text(json.dumps({"schemaVersion": "1", "paperCount": 1, "papers": [{"id": "p1", "number": 1, "segmentCount": 9, "title": "t"}]}))
    assert corpus_json.catalogue(spark, str(f)).first().paper_id == "p1"
    f.write_text(json.dumps({"paperCount": 2, "papers": [{"id": "p1"}]}))
    with pytest.raises(quality.InvalidInput):
        corpus_json.catalogue(spark, str(f))
    crops = tmp_path / "paper-07"
    crops.mkdir()
    (crops / "manifest.json").write_text(json.dumps({"figures": [{"label": "Fig 1", "page": 2, "bbox": [1, 2.5, 3, 4], "dpi": 300, "status": "ok"}]}))
    assert corpus_json.crops(spark, str(crops / "manifest.json")).first().paper_id == "paper-07"
    states = spark.createDataFrame([("p", 1)], "paper_id string, version int")
    sinks.persist(states, str(tmp_path / "state"))
    sinks.persist(spark.createDataFrame([("q", 2)], "paper_id string, version int"), str(tmp_path / "state"))
    assert sorted(r.paper_id for r in spark.read.parquet(str(tmp_path / "state")).collect()) == ["p", "q"]
    segs = spark.createDataFrame([("p", "a", 1, "Intro", [(3,), (4,), (3,)])], "paper_id string, id string, `order` int, section string, fragments array<struct<page:int>>")
    reader = spark.createDataFrame([("p", "r", {"a": " note "}, ["a"], [])], "paper_id string, reader_id string, notes map<string,string>, bookmarks array<string>, understood array<string>")
    docs = spark.createDataFrame([("p", "Title", "f.pdf", "abc")], "paper_id string, title string, sourceFileName string, sourceSha256 string")
    md = sinks.notes_markdown(segs, reader, docs, F.lit("now")).first().markdown
    assert md == "# Title\n\n- 來源檔案：f.pdf\n- 來源 SHA-256：`abc`\n- 匯出時間：now\n\n## Intro · 第 3、4 頁\n\n- 段落 ID：`a`\n- 書籤：是\n- 已理解：否\n\nnote\n"


def test_reconcile_with_repairs(spark):
    schema = "paper_id string, id string, `order` int, sourceText string, excluded boolean"
    stored = spark.createDataFrame([("p", "a", 1, "A", None), ("p", "c", 2, "C", True), ("bad", "x", 1, "edited", None)], schema)
    source = spark.createDataFrame([("p", "a", 1, "A", True), ("p", "b", 2, "B", None), ("p", "c", 3, "C", False), ("bad", "x", 1, "X", None), ("new", "n", 1, "N", None)], schema)
    previous = spark.createDataFrame([("p", ["z"])], "paper_id string, previous_ids array<string>")
    got = merge.reconcile(stored, source, broken=spark.createDataFrame([("bad",)], "paper_id string"), previous=previous)
    assert sorted(tuple(r) for r in got.collect()) == [("bad", "x", 1, "X", None), ("new", "n", 1, "N", None), ("p", "a", 1, "A", True), ("p", "b", 2, "B", None), ("p", "c", 3, "C", True)]
    same = merge.reconcile(stored.filter("paper_id = 'p'"), source.filter("paper_id = 'p'"), previous=spark.createDataFrame([("p", ["a", "c"])], "paper_id string, previous_ids array<string>"))
    assert [r.id for r in same.orderBy("order").collect()] == ["a", "b", "c"]


def test_mark_understood(spark):
    df = spark.createDataFrame([("a", ["b"]), ("b", ["b"]), ("c", None)], "currentSegmentId string, understood array<string>")
    assert sorted(r.understood for r in state.mark_understood(df).collect()) == [["b"], ["b", "a"], ["c"]]


def test_command(spark, tmp_path, capsys):
    import json

    from glossa import cli

    (tmp_path / "in.json").write_text(json.dumps(PAGE, ensure_ascii=False))
    (tmp_path / "t.html").write_text("<!doctype html><html>" + " ".join(study.TOKENS) + "</html>")
    assert cli.main([str(tmp_path / "in.json"), "--validate-only"]) == 0 and "valid: nodes=2; statistics=0; glossary=1; discussions=4; easy_sections=1" in capsys.readouterr().out
    args = [str(tmp_path / "in.json"), str(tmp_path / "out.html"), "--template", str(tmp_path / "t.html")]
    assert cli.main(args) == 0 and cli.main(args) == 2 and cli.main([*args, "--force"]) == 0
    assert cli.main([str(tmp_path / "in.json"), str(tmp_path / "out.txt"), "--template", str(tmp_path / "t.html")]) == 2
    (tmp_path / "bad.json").write_text(json.dumps(PAGE | {"title": ""}))
    assert cli.main([str(tmp_path / "bad.json"), "--validate-only"]) == 2


def test_slug_of_whole_texts(spark, tmp_path):
    import re
    import unicodedata

    from glossa.plans import corpus

    texts = ["! " * 150 + "The end, 標題 of 7", "я" * 300 + " Ünï", "word " * 60, "--", "", None, "。" * 250]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: re.sub("[^a-zA-Z0-9\u4e00-\u9fff]+", "-", unicodedata.normalize("NFKD", t or "")).strip("-")[:72] or "paper-notes" for k, t in enumerate(texts)}
    assert want[0] == "The-end-標題-of-7" and {r.doc_id: r.slug for r in corpus.slug(spark, str(tmp_path)).collect()} == want


def test_free_names_skip_taken_numbers(spark):
    taken = spark.createDataFrame([("p", x) for x in ("a", "a-2", "a-02", "b-2", "c", "c-2", "c-3", "d-2", "d-2-2")], "paper_id string, id string")
    wanted = spark.createDataFrame([("p", x) for x in ("a", "b", "c", "d-2", "e")], "paper_id string, base string")
    assert {r.base: r.id for r in edits.unique_ids(wanted, taken).collect()} == {"a": "a-3", "b": "b", "c": "c-4", "d-2": "d-2-3", "e": "e"}


def test_documents_of_unequal_sides(spark, tmp_path):
    """Joins that are planned alike, of which one turns out to be small enough for a broadcast."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        spark.range(0, 20_000, 1, 8).select(F.col("id").alias("paper_id"), F.sha2(F.col("id").cast("string"), 512).alias("title"), F.lit("new").alias("citations")).write.parquet(f"{tmp_path}/t")
        source = spark.read.parquet(f"{tmp_path}/t")
        stored = source.filter("paper_id % 50 = 0").select("paper_id", F.concat(F.lit("mine"), "title").alias("title"), F.lit("old").alias("citations"))
        segs = source.select("paper_id", F.lit("1").alias("id"), F.lit(1).alias("order"), F.lit("t").alias("sourceText"))
        got, own = merge.reconcile_documents(stored, source, segs.filter("paper_id % 50 = 0"), segs)
        rows = got.join(own.select("paper_id").distinct(), "paper_id", "left_semi").collect()
        assert len({r.paper_id for r in rows}) == len(rows) == 20_000
        assert all(r.citations == "new" and r.title.startswith("mine") == (r.paper_id % 50 == 0) for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_percent_of_halves(spark):
    """29 of 200 are 14.5 %, which rounds up; 29 / 200 * 100 is less in doubles."""
    row = spark.range(1).select(geometry.percent(F.lit(29), F.lit(200)).alias("a"), geometry.percent(F.lit(57), F.lit(200)).alias("b"), geometry.percent(F.lit(0), F.lit(0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (15, 29, 0)
