"""Near-duplicate documents: sets of five-word shingles that share 80 % (Jaccard).

Documents with equal sets are one node with a SimHash fingerprint. Candidates come from two searches. Vantage-point trees find
the fingerprints that differ in at most three bits. Those are the closest pairs only: at 0.8 two fingerprints differ in
about ten bits of 64, while a tree that must find that much can leave out nothing (unrelated ones differ in 32). The rest
agree in one of BANDS keys, each of ROWS smallest hashes; a pair at 0.8 is missed with a probability of 5e-6.

Every candidate is a pair with the first node of its key, and is compared first, exactly: a group of near copies is joined
by as many comparisons as it has members. What candidates connect and these links don't is compared all with all: the
sets of such a component meet in a task, or, where they are many, in one task for each two pieces of it. What the links have
joined already isn't compared with itself, and a large joined group only meets the pieces of others, so that a group of
any size costs its members times the few that candidates tie to it from outside.

Defined results: words are runs without ASCII blanks, A-Z lower-cased; a shorter text is one shingle; null and wordless
texts are alike; rows without doc_id take no part and are kept; rows that repeat a doc_id are judged each by its own text;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common, simhash
from glossa.llm.components import components
from glossa.llm.passages import _mix, slices

BANDS, ROWS, PIECE = 40, 6, 512
_FACTORS = _mix(np.arange(BANDS * ROWS, dtype=np.uint64), 1000) | np.uint64(1)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets(texts: list[bytes | None]):
    """The sorted set of shingle hashes of each text."""
    texts = [t or b"" for t in texts]
    for first, x in slices(texts):
        for k, own in enumerate(x):
            yield np.unique(own) if len(own) else np.array([xxhash.xxh64_intdigest(b" ".join(texts[first + k].translate(_LOWER).split()), 5)], np.uint64)


def bands(x: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set; each of the smallest hashes is that of a product with an odd number of its own."""
    with np.errstate(over="ignore"):
        low = np.concatenate([(x[None, :] * odd[:, None]).min(axis=1) for odd in _FACTORS.reshape(-1, ROWS)]).reshape(BANDS, ROWS)
        key = np.zeros(BANDS, np.uint64)
        for r in range(ROWS):
            key = key * np.uint64(0x9E3779B97F4A7C15) + low[:, r]
        return _mix(key + np.arange(BANDS, dtype=np.uint64), 999)


def _described(batches):
    for batch in common.parts(batches, 500):
        rows = [[], [], [], []]
        for x in sets(batch.column(1).to_pylist()):
            for column, v in zip(rows, (xxhash.xxh64_intdigest(x.tobytes(), 11), simhash.majority(x), bands(x).view(np.int64), (x >> np.uint64(32)).astype(np.uint32).tobytes()), strict=True):
                column.append(v)
        long = lambda c: pa.array(np.array(c, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), long(rows[0]), long(rows[1]), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.binary())], ["doc_id", "mark", "node", "fp", "bands", "data"])


def candidates(own: DataFrame) -> DataFrame:
    """(a, b) of nodes that may be alike, enough to join those that are. own: (node, fp, bands)."""
    banded = own.select("node", F.explode("bands").alias("band"))
    first = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b <> c")
    met = banded.join(first.select("band", "b"), "band").select(F.col("node").alias("a"), "b")
    prints = common.checkpointed(own.groupBy("fp").agg(F.min("node").alias("node")).select("node", "fp"))
    equal = own.select("fp", F.col("node").alias("a")).join(prints.select("fp", F.col("node").alias("b")), "fp").select("a", "b")
    return met.unionByName(equal).filter("a <> b").distinct().unionByName(simhash.linked(prints))


def compare(x: list[np.ndarray], side: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, enough to join what belongs together; with two sides only sets of different sides are compared,
    and those of one known group never."""
    flat = np.concatenate(x)
    size = np.array([len(s) for s in x])
    start = np.cumsum(size) - size
    _, inverse = np.unique(flat, return_inverse=True)
    root, out, mixed = np.arange(len(x)) if known is None else np.unique(known, return_inverse=True)[1], [], len(np.unique(side)) > 1
    mark = np.zeros(inverse.max() + 1, bool)
    for k in range(len(x)):
        open_ = (root != root[k]) & (5 * np.minimum(size, size[k]) >= 4 * np.maximum(size, size[k]))
        if mixed:
            open_ &= side != side[k]
        else:
            open_[: k + 1] = False
        if not open_.any():
            continue
        own = inverse[start[k] : start[k] + size[k]]
        mark[own] = True
        shared = np.add.reduceat(mark[inverse], start)
        mark[own] = False
        for j in np.flatnonzero(open_ & (9 * shared >= 4 * (size + size[k]))).tolist():
            if root[j] != root[k]:
                root[root == root[j]] = root[k]
                out.append((k, j))
    return out


def _verified(key, table):
    node, root, group, side = (table.column(c).to_numpy() for c in ("node", "root", "group", "side"))
    data = [np.frombuffer(d, np.uint32) for d in table.column("data").to_pylist()]
    order = np.lexsort((node, root))
    found = []
    for p in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        found += [(node[p[a]], node[p[b]]) for a, b in compare([data[k] for k in p.tolist()], side[p], group[p])]
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _alike(batches):
    """The pairs of sets that share 80 %."""
    for batch in common.parts(batches, 1000):
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            keep.append(5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _pieces(named: DataFrame, n: int) -> DataFrame:
    """(name, root, group, side, task): the nodes of candidate components that hold several groups of links, dealt to tasks.
    named: (node, root, group). Groups of PIECE nodes and more have pieces of their own, which meet all pieces but those;
    the nodes of smaller groups share pieces, which meet all."""
    open_ = named.groupBy("root").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("root")
    left = named.join(open_, "root", "left_semi")
    sizes = left.groupBy("root", "group").agg(F.count(F.lit(1)).alias("k"))
    large, cut = F.col("k") >= PIECE, lambda k: (F.floor(k / PIECE) + 1).cast("int")
    own = F.collect_list(F.when(large, F.struct("group", cut(F.col("k")).alias("pieces"))))
    held = sizes.groupBy("root").agg(cut(F.sum(F.when(large, 0).otherwise(F.col("k")))).alias("shared"), own.alias("own"))
    rows = left.join(sizes.filter(large).select("root", "group", cut(F.col("k")).alias("pieces")), ["root", "group"], "left").join(held, "root")
    name = lambda group, k: F.concat_ws(":", group, k.cast("string"))
    shared, group = F.lit("shared"), F.col("group").cast("string")
    here = F.when(F.col("pieces").isNotNull(), name(group, F.pmod(F.xxhash64("node"), F.col("pieces")))).otherwise(name(shared, F.pmod(F.xxhash64("group"), F.col("shared"))))
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    others = F.filter("own", lambda o: F.col("pieces").isNull() | (o["group"] != F.col("group")))
    met = F.concat(F.transform(upto(F.col("shared")), lambda k: name(shared, k)), F.flatten(F.transform(others, lambda o: F.transform(upto(o["pieces"]), lambda k: name(o["group"].cast("string"), k)))))
    alone = (F.col("shared") == 1) & (F.size("own") == 0)
    dealt = rows.select(F.col("node").alias("name"), "root", "group", here.alias("here"), F.explode(met).alias("other"), alone.alias("alone"))
    # Two pieces of one component meet in one task, a shared piece also itself; small components share tasks.
    pair = F.xxhash64("root", F.least("here", "other"), F.greatest("here", "other"))
    task = F.when(F.col("alone"), F.pmod(F.xxhash64("root"), F.lit(n))).otherwise(n + F.pmod(pair, F.lit(1 << 61)))
    return dealt.select("name", "root", "group", (F.col("here") > F.col("other")).cast("int").alias("side"), task.alias("task"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, component_id) for every row with an id: the smallest id of the documents that links join. mark is
    xxhash64 of the text, for rows that repeat an id."""
    n = common.partitions_for(docs)
    rows = common.id_and_bytes(docs, id_col, text_col).filter("doc_id is not null").withColumn("mark", F.xxhash64("text"))
    own = common.checkpointed(rows.mapInArrow(_described, "doc_id long, mark long, node long, fp long, bands array<long>, data binary"))
    edges = common.checkpointed(candidates(own))
    joined = components(edges)
    named = common.checkpointed(joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct()))
    texts = common.checkpointed(own.select("node", "data").join(named, "node", "left_semi").dropDuplicates(["node"]))
    held = lambda c: texts.select(F.col("node").alias(c), F.col("data").alias(f"{c}_data"))
    met = edges.join(held("a"), "a").join(held("b"), "b").select("a", "b", "a_data", "b_data")
    direct = common.checkpointed(met.mapInArrow(_alike, "a long, b long"))
    groups = components(direct).withColumnRenamed("root", "group")
    grouped = common.checkpointed(named.join(groups, "node", "left").select("node", "root", F.coalesce("group", "node").alias("group")))
    dealt = _pieces(grouped, n)
    rest = texts.join(dealt, F.col("node") == F.col("name")).select("task", "node", "root", "group", "side", "data").groupBy("task").applyInArrow(common.lean(_verified), "a long, b long")
    roots = components(direct.unionByName(rest)).select(F.col("node").alias("name"), F.col("root").alias("head"))
    placed = common.checkpointed(own.select("doc_id", "mark", "node").join(roots, F.col("node") == F.col("name"), "left").select("doc_id", "mark", F.coalesce("head", "node").alias("head")))
    common.forget(own, edges, named, texts, direct, grouped)
    first = placed.groupBy("head").agg(F.min("doc_id").alias("component_id")).select(F.col("head").alias("h"), "component_id")
    return placed.join(first, F.col("head") == F.col("h")).select("doc_id", "mark", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document (the smallest doc_id) of every component, with all their columns."""
    name, mark = common.isolated("id"), common.isolated("mark")
    gone = near_duplicates(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(name), F.col("mark").alias(mark)).distinct()
    own = F.xxhash64(F.col(text_col).cast("string").cast("binary"))
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(name)) & (own == F.col(mark)), "left_anti")
