"""Operators that fold events or repairs in order, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import edits, merge, state, study


def stacks(visits):
    out = {}
    for reader, _, target in sorted(visits, key=lambda v: (v[0] or "", v[1])):
        own = out.setdefault(reader, [])
        if target is not None:
            own.append(target)
        elif own:
            own.pop()
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("parts", [1, 7])
def test_back_stack(spark, parts):
    rng = random.Random(parts)
    visits = [(reader, n, rng.choice([None, "t"]) and f"{reader}{n}") for reader, many in (("hot", 900), ("a", 40), ("b", 1), (None, 30)) for n in range(many)]
    visits += [("goes", n, f"g{n}" if n < 50 else None) for n in range(80)] + [("deep", n, f"d{n}") for n in range(200)]
    rng.shuffle(visits)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in state.back_stack(spark.createDataFrame(visits, "reader string, n int, target string"), "reader", ["n"], "target").orderBy("depth").collect():
            assert r.depth == len(got.setdefault(r.reader, [])) + 1
            got[r.reader].append(r.target)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == stacks(visits)
    assert state.back_stack(spark.createDataFrame([], "reader string, n int, target string"), "reader", ["n"], "target").count() == 0


SEGMENT = "paper_id string, id string, sourceText string, fragments array<int>, translation string, reviewStatus string, excluded boolean, mergedIntoSegmentId string"
REPAIR = "paper_id string, position int, targetId string, previousSegments array<struct<id:string,sourceText:string,fragments:array<int>,translation:string>>, absorbedIds array<string>"
TEXT, FRAGMENTS, TRANSLATION, REVIEW, EXCLUDED, MERGED = range(2, 8)


def repaired(stored, source, repairs):
    own, new = {(r[0], r[1]): list(r) for r in stored}, {(r[0], r[1]): r for r in source}
    marks = set()
    for paper, _, target, previous, absorbed in sorted(repairs, key=lambda r: (r[0], r[1])):
        now, fresh = own.get((paper, target)), new.get((paper, target))
        if not now or not fresh:
            continue
        already = now[TEXT] == fresh[TEXT] and now[FRAGMENTS] == fresh[FRAGMENTS]

        def held(p, paper=paper):
            x = own.get((paper, p[0]))
            return bool(x) and x[TEXT] == p[1] and x[FRAGMENTS] == p[2] and x[TRANSLATION] == p[3] and x[REVIEW] not in ("reviewed", "published")

        untouched = all(held(p) for p in previous or [])
        if not already and not untouched:
            marks |= {(paper, target, "pending")} | {(paper, i, "protected") for i in absorbed or []}
            continue
        replaced = untouched and not already
        for i in absorbed or []:
            x = own.get((paper, i))
            if x and not (replaced and i == target):
                x[MERGED], x[EXCLUDED] = target, True if x[EXCLUDED] is None else x[EXCLUDED]
        if replaced:
            kept = now[EXCLUDED]
            own[paper, target] = [*fresh[:EXCLUDED], fresh[EXCLUDED] if kept is None else kept, fresh[MERGED]]
    return {tuple(str(v) for v in x) for x in own.values()}, marks


def check_repairs(spark, stored, source, repairs):
    rows, marks = merge.unit_repairs(spark.createDataFrame(stored, SEGMENT), spark.createDataFrame(source, SEGMENT), spark.createDataFrame(repairs, REPAIR))
    want = repaired(stored, source, repairs)
    assert {tuple(str(v) for v in r) for r in rows.collect()} == want[0]
    assert {tuple(r) for r in marks.collect()} == want[1]


def test_repairs_that_follow_each_other(spark):
    rng = random.Random(8)
    segment = lambda p, i, text: (p, i, text, [1], "t", rng.choice([None, None, None, "reviewed"]), rng.choice([None, None, False]), None)
    papers, ids = [f"p{k}" for k in range(30)], [f"s{k}" for k in range(6)]
    stored = [segment(p, i, "old") for p in papers for i in ids if rng.random() < 0.95]
    source = [(p, i, rng.choice(["old", "new"]), [1], "t", None, rng.choice([None, True]), None) for p in papers for i in ids if rng.random() < 0.95]
    before = lambda: [(i, rng.choice(["old", "old", "new"]), [1], "t") for i in rng.sample(ids, rng.randrange(3))]
    repairs = [(p, k, rng.choice(ids), rng.choice([None, before(), before()]), rng.choice([None, rng.sample(ids, 2), ["gone"]])) for p in papers for k in range(rng.randrange(5))]
    check_repairs(spark, stored, source, repairs)
    check_repairs(spark, stored, source, [])


def test_a_long_paper(spark):
    """A paper of 100,000 segments, of which some are repaired: nothing gathers it."""
    stored = [("p", f"s{k}", "old", [1], "t", None, None, None) for k in range(100_000)]
    source = [("p", f"s{k}", "new", [1], "t", None, None, None) for k in range(0, 100_000, 10)]
    repairs = [("p", k, f"s{k * 10}", [(f"s{k * 10}", "old", [1], "t")], [f"s{k * 10 + 1}"]) for k in range(10_000)]
    repairs += [("p", 20_000, "s0", [("s0", "old", [1], "t")], ["s2"]), ("p", 20_001, "s10", None, ["s0"])]
    check_repairs(spark, stored, source, repairs)


def nodes_of(elements, nodes):
    out = {}
    for element, data in elements:
        hits = [n for n in nodes if n == element or element.startswith(n + "-") or element.endswith("-" + n) or f"-{n}-" in element]
        best = max(hits, key=lambda n: (len(n), n), default=None)
        out[element] = best if best is not None else (data if data in nodes else None)
    return out


def test_node_of_element(spark):
    nodes = ["A", "A1", "B.c", "x-y", "x-y-z", "long-" * 30 + "end"]
    elements = [("flowchart-A1-7", None), ("A", None), ("n-x-y-3", "A"), ("q-x-y-z", None), ("none", "B.c"), ("none-2", "other"), ("none-3", None), ("-".join(["w"] * 200), None), ("p-" + "long-" * 30 + "end-9", None), ("xx-y", None), ("", "A1")]
    got = study.node_of_element(spark.createDataFrame(elements, "element_id string, data_id string"), spark.createDataFrame([(n,) for n in [*nodes, "A"]], "node_id string"))
    assert {r.element_id: r.node_id for r in got.collect()} == nodes_of(elements, nodes)
    assert all(r.node_id is None for r in study.node_of_element(spark.createDataFrame(elements[:2], "element_id string, data_id string"), spark.createDataFrame([], "node_id string")).collect())


def test_lookups_by_parts_are_few(spark):
    """An id of 200 parts is looked up by as many stretches as it has parts for each size of node ids."""
    from pyspark.sql import Column

    made: list[Column] = study._runs(F.split("e", "-"), F.sequence(F.lit(1), F.size(F.split("e", "-"))), 1)
    rows = spark.createDataFrame([("-".join(f"t{k}" for k in range(200)),)], "e string").select(F.size(made).alias("n"))
    assert rows.first().n == 200


@pytest.mark.parametrize("units", [1, 2, 3, 5, 8, 40])
def test_utf16_prefix(spark, units):
    texts = ["plain text", "𝄞 clef 𝄞𝄞", "é中文𝄞", "𝄞", "", "a𝄞b" * 30]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", edits.utf16_prefix(F.col("t"), F.lit(units)).alias("n"), edits.utf16_length(F.col("t")).alias("size")).collect()
    for r in got:
        code = r.t.encode("utf-16-be")
        assert r.size == len(code) // 2
        assert r.n == len(code[: 2 * units].decode("utf-16-be", "ignore"))
