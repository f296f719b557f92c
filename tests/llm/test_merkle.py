"""Merkle manifests against trees folded level by level in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossa.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part string, digest string, at int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(told, row))


def tree(nodes):
    """The root, and for each node the siblings left and right of its path."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[1], []).append(r)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(parts[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([made[s][1] for s in names])
    out = []
    for s, upper in zip(names, above, strict=True):
        own, subroot, paths = made[s]
        for r, path in zip(own, paths, strict=True):
            d = leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                d = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path + upper:
                d = h(a, d, b)
            out.append((r[0], leaf(r), subroot, root, h(*(a + b for a, b in path + upper)), d, d == root))
    return out


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "p", "d", 3, "r") for r in rows], SCHEMA).repartition(parts)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    table = merkle.manifest(docs, FIELDS, {"text": F.translate("text", upper, upper.lower())}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return sorted(map(tuple, table.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 300, 511, 513, 4095, 4096])
def test_walk_gives_each_path(n):
    leaves = [h(str(k)) for k in range(n)]
    root, paths = tree(leaves)
    height = merkle.height_of(0, n)
    assert [list(p) for p in merkle.walk(leaves, height)] == paths
    assert merkle.top(leaves, height) == root
    assert all(merkle.folded(x, p) == root for x, p in zip(leaves[::97], paths[::97], strict=True))


def test_walk_holds_few_nodes():
    """Two runs a level and their stacks, whatever the number of leaves."""
    held = []
    push = merkle.Treehash.push

    class Counted(merkle.Treehash):
        def push(self, digest):
            push(self, digest)
            held.append(sum(map(len, self.stacks)))

    merkle_treehash, merkle.Treehash = merkle.Treehash, Counted
    try:
        for _ in merkle.walk([h(str(k)) for k in range(4096)], 3):
            pass
    finally:
        merkle.Treehash = merkle_treehash
    assert max(held) <= 16 * 4


def test_manifest_is_the_plain_tree(spark):
    rng = random.Random(1)
    texts = ["Some Text", "", None, "plain", "Ünï ÀÉ Z", "x" * 9000, "A\x00B"]
    rows = [(k, rng.choice(["a", "b", "é", "", None, f"s{k}"]), rng.choice(["en", None, ""]), rng.choice([0, None, 7]), rng.choice(texts)) for k in range(300)]
    rows += [rows[4], rows[4], (4, "b", None, None, "Other"), (None, "b", "en", 1, "No Id"), (None, None, None, None, None), (-3, "a", "en", 1, "Negative")]
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_hot_part_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle.common, "PARTITION_BYTES", 40_000)
    rows = [(k, "hot" if k % 3 else f"s{k % 40}", "en", k, f"Text {k}") for k in range(14_000)]
    assert got(spark, rows, 5) == sorted(plain(rows), key=str)


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, None, None)]) == sorted(plain([(1, None, None, None, None)]), key=str)
