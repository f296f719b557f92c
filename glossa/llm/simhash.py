"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64 bits over word shingles. Only distinct fingerprints are compared: each is one node, named by its
smallest doc_id. A vantage-point tree over a bounded sample cuts the space into shards of about SHARD fingerprints by
Hamming distance; a fingerprint lives in one shard and visits every other that the triangle inequality can't rule out
(a shard beyond a boundary that is nearer than the radius). Inside a shard a tree of its own is searched the same way,
down to blocks of LEAF, and exact distances decide. A shard returns a star per component of what it found, so a dense
group gives a row per member and not a row per pair, and the stars are joined to components across shards.

Defined results: a null or wordless text has fingerprint zero and links like any other; rows without doc_id get a
fingerprint but take no part in linking (component null); repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.llm.components import components

RADIUS, WORDS, SEED = 3, 3, 42
#: Fingerprints a shard should hold, where a shard's own tree stops, and the sample that places the shards: so many for each
#: shard, but no fewer and no more (2 MB) in all.
SHARD, LEAF, EACH, SAMPLE, MOST = 8192, 96, 16, 4096, 1 << 18

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(data: bytes | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of UTF-8 bytes: words are runs without blank and control space, A-Z lower-cased."""
    own = (data or b"").translate(_LOWER).split()
    if not own:
        return 0
    if len(own) <= words:
        shingles = [b" ".join(own)]
    else:
        flat = b" ".join(own)
        size = np.fromiter(map(len, own), np.int64, len(own)) + 1
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        end = (start + size - 1)[words - 1 :].tolist()
        shingles = [flat[i:j] for i, j in zip(start.tolist(), end)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        count += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits in a signed long, for every row."""

    def run(batches):
        for batch in common.parts(batches, 500):
            got = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "fp"])

    return common.id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def build(sample: np.ndarray, depth: int) -> list[tuple[np.uint64, int]]:
    """A complete tree of that depth as (vantage point, radius) in heap order; inside means at most the radius away."""
    nodes: list = [None] * ((1 << depth) - 1)
    held = {0: sample}
    for k in range(len(nodes)):
        own = held.pop(k)
        if len(own) < 4:
            own = sample
        tries = own[:: max(1, len(own) // 8)][:8]
        spread = [distance(own, v) for v in tries]
        # The point whose boundary has the fewest fingerprints near it, among those that cut about in half.
        best = min(range(len(tries)), key=lambda j: (np.abs(spread[j] - np.median(spread[j])) <= RADIUS).mean())
        d, v = spread[best], tries[best]
        radius = int(np.median(d))
        if (d <= radius).mean() > 0.75:
            radius -= 1
        nodes[k] = (v, radius)
        held[2 * k + 1], held[2 * k + 2] = own[d <= radius], own[d > radius]
    return nodes


def route(fp: np.ndarray, nodes: list, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) for every shard that a fingerprint lives in or has to visit."""
    row, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    while len(nodes) and len(node) and node[0] < len(nodes):
        r, n, h = [], [], []
        for k in np.unique(node):
            at = node == k
            v, mu = nodes[k]
            d = distance(fp[row[at]], v)
            for child, inside, near in ((2 * k + 1, d <= mu, d - radius <= mu), (2 * k + 2, d > mu, d + radius > mu)):
                r.append(row[at][near])
                n.append(np.full(int(near.sum()), child))
                h.append((home[at] & inside)[near])
        row, node, home = np.concatenate(r), np.concatenate(n), np.concatenate(h)
    return row, node - len(nodes), home


class Stars:
    """Components of the points of one shard, taken from pairs as they come."""

    def __init__(self, n: int):
        self.parent, self.a, self.b, self.size = np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.size += len(a)
            if self.size > 1 << 20:
                self.flush()

    def flush(self) -> np.ndarray:
        if self.size:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            self.a, self.b, self.size = [], [], 0
            p = self.parent
            while True:
                x, y = p[a], p[b]
                live = x != y
                if not live.any():
                    break
                a, b, x, y = a[live], b[live], x[live], y[live]
                np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
                while (q := p[p]).tobytes() != p.tobytes():
                    p = q
            self.parent = p
        return self.parent


def search(fp: np.ndarray, members: np.ndarray, queries: np.ndarray, found: Stars, radius: int = RADIUS) -> None:
    """All pairs of a member and a query within the radius, by a tree over the members (both are positions in fp)."""
    stack = [(members, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            v = fp[p[len(p) // 2]]
            d = distance(fp[p], v)
            mu = int(np.median(d))
            inside = d <= mu
            if inside.all():
                mu -= 1
                inside = d <= mu
            if inside.any():
                e = distance(fp[q], v)
                stack.append((p[inside], q[e - radius <= mu]))
                stack.append((p[~inside], q[e + radius > mu]))
                continue
        step = max(1, (1 << 21) // len(p))
        for k in range(0, len(q), step):
            own = q[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fp[own][:, None] ^ fp[p][None, :]) <= radius)
            a, b = own[i], p[j]
            keep = a != b
            found.add(a[keep], b[keep])


def _shard(table: pa.Table) -> pa.Table:
    fp = table.column("fp").to_numpy().view(np.uint64)
    node, home = table.column("node").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
    order = np.argsort(node, kind="stable")  # so that the smallest position is the smallest node
    fp, node, home = fp[order], node[order], home[order]
    found = Stars(len(fp))
    search(fp, np.flatnonzero(home), np.arange(len(fp)), found)
    root = found.flush()
    at = np.flatnonzero(root != np.arange(len(fp)))
    return pa.table({"a": node[at], "b": node[root[at]]})


def linked(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): stars over all nodes (node long, fp long, both distinct) whose fingerprints differ in at most radius bits."""
    count = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / SHARD))))
    tree: list = []
    if depth:
        part = nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(8)) == 0).orderBy(F.xxhash64("fp")).select("fp").limit(min(MOST, max(SAMPLE, EACH << depth))).collect()
        tree = build(np.array([r.fp for r in part], np.int64).view(np.uint64), depth)

    def run(batches):
        for batch in batches:
            fp = batch.column(1).to_numpy().view(np.uint64)
            row, shard, home = route(fp, tree, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(home)], ["shard", "node", "fp", "home"])

    routed = nodes.select("node", "fp").mapInArrow(run, "shard long, node long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(_shard, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    own = common.checkpointed(fingerprints(docs, id_col, text_col))
    nodes = common.checkpointed(own.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"))
    roots = components(linked(nodes))
    named = common.checkpointed(nodes.join(roots, "node", "left").select(F.col("fp").alias("fp2"), F.coalesce("root", "node").alias("component")))
    return own.join(named, F.col("fp") == F.col("fp2"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
