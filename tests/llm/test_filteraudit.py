"""The filter audit against every order applied row by row."""

import itertools
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from glossa.llm import filteraudit

DOCS = "doc_id long, text string, source string, part int, fails string, n long"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The failed filters of each (doc_id, text), by their definitions."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        out.append({k for k, v in own.items() if v})
    return out


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    failed = fails([(i, t) for i, t, _ in rows])
    out, shares = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, failed, strict=True) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shares[part, x] += len(gone)
                early = sum(x in f and bool(f & set(order[: step - 1])) for _, f in own)
                out[part, order, step] = [len(left), len(gone), early, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, rows, labels, parts=4):
    docs = spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], DOCS).repartition(parts)
    failed = filteraudit.failures(docs)
    table = filteraudit.audit(filteraudit.counters(failed, spark.createDataFrame(labels, LABELS)))
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in table.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n, pool=words: " ".join(rng.choice(pool) for _ in range(n))
    texts = [prose(60), prose(20), prose(200, words[:20]), prose(60).upper(), prose(60) + " 50% |", None, "", " \t\n", "é" * 40 + " A", "x" * 5000, prose(9000), "a\x00b", prose(60) + "\x1c#"]
    out = [(k, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for k in range(150)]
    hot = prose(55)
    out += [(1000 + k, hot, "hot") for k in range(120)]
    return [*out, out[3], out[3], (None, hot, "s1"), (None, None, None), (1000, "other text", "s2"), (1005, hot, "hot")]


def test_audit_is_every_order_applied(spark, rows):
    rng = random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows[::2]]
    labels += [labels[0], (labels[1][0], 1, 1), (77777, 1, 1), (None, 1, 1)]
    assert got(spark, rows, labels) == plain(rows, labels)


def test_one_text_over_many_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(filteraudit.common, "PARTITION_BYTES", 200)
    assert got(spark, rows, [(1, 1, 0)], parts=9) == plain(rows, [(1, 1, 0)])


def test_shared_fingerprints_are_told_apart():
    """Rows of two partitions, all under one fingerprint: texts are told apart by themselves and by their digests."""
    def part(pid, rows):
        columns = [[i for i, _ in rows], ["p"] * len(rows), [0] * len(rows), [pid] * len(rows), [7] * len(rows), [t for _, t in rows]]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "part", "fails", "pid", "print", "text"])
        out = list(filteraudit._against_predecessor(whole.slice(k, 2) for k in range(0, len(rows), 2)))
        return [r for b in out for r in b.to_pylist()]

    one = part(0, [(1, b"a"), (4, b"a"), (5, b"a"), (2, b"b"), (3, b"c")])
    two = part(1, [(9, b"a"), (8, b"b"), (11, b"b"), (10, b"d")])
    assert [r["fails"] for r in one[:5]] == [0, 16, 16, 0, 0]
    assert [r["fails"] for r in two[:4]] == [0, 0, 16, 0]
    first = {(r["pid"], r["digest"]): r["first"] for r in one + two if r["fails"] is None}
    assert sorted(v for (p, _), v in first.items() if p == 0) == [1, 2, 3] and sorted(v for (p, _), v in first.items() if p == 1) == [8, 9, 10]
    assert len({d for _, d in first}) == 4


def test_no_rows(spark):
    assert got(spark, [], []) == {}
    assert got(spark, [(1, None, None)], [])[("", "ABCDE", 1)] == (0, 1, 0, 1, 0, 0, 120)
