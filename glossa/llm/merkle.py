"""Merkle manifest of a dataset: a digest of every row, a root of every part, one root of all, and a proof for each row.

A tree of sixteen branches stands over the leaves of a part (by id), and another over the parts' roots (by name). Positions
come from one sort over ranges of (part, id), so that a part with a third of all rows lies in many partitions, and the
counts of the partitions before. The tree is then built in rounds of aligned blocks of 16^3 nodes: going up, each block is
folded to its top node, and the tops are the next round's nodes, until one is left of each part; 10^12 leaves take four
rounds. Going down, each block gets the path from its top to the root, which all its leaves share, and walks over its
leaves: a treehash for each level builds the next run of siblings while the present run is in use, one leaf at a step, so
that besides the block's leaves no more than two runs of sixteen nodes and their stacks are held for each level.

Defined results: null values have a mark of their own, apart from empty ones; rows that repeat an id stand side by side in
the order of their digests, each with its own place and proof; a null id comes before all others of its part and is never
tampered with; null parts come before all others. An empty table has no rows and no root. Where every row is a part of its
own, the shared paths are as many as the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import common

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
NULL = "-"


def combined(digests: list[str]) -> str:
    """H: the digest of digests as hexadecimal text, one after the other."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of values in order, each with its length in bytes."""
    told = (F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit(NULL)) for f in fields)
    return F.unhex(F.sha2(F.concat(*told), 256))


class Treehash:
    """The nodes of one height, made leaf by leaf. Nodes of lower heights wait on stacks until there are ARITY of them."""

    def __init__(self, height: int):
        self.height = height
        self.stacks: list[list[str]] = [[] for _ in range(height + 1)]

    def push(self, digest: str) -> None:
        self.stacks[0].append(digest)
        for h in range(self.height):
            if len(self.stacks[h]) < ARITY:
                return
            self._close(h)

    def _close(self, h: int) -> None:
        self.stacks[h + 1].append(combined(self.stacks[h]))
        self.stacks[h].clear()

    def finish(self) -> list[str]:
        """The nodes of this height; a last run may be short."""
        for h in range(self.height):
            if self.stacks[h]:
                self._close(h)
        return self.stacks[-1]


def height_of(block: int, n: int) -> int:
    """The levels of a block: all of them if its tree has more blocks, else as many as its nodes need."""
    h = 0
    while h < LEVELS and (block or ARITY**h < n):
        h += 1
    return h


def top(leaves: list[str], height: int) -> str:
    tree = Treehash(height)
    for x in leaves:
        tree.push(x)
    return tree.finish()[0]


def walk(leaves: list[str], height: int):
    """For each leaf in order, for each level upward, the siblings left and right of its path, each as one string."""
    spans = [ARITY**h for h in range(height + 1)]
    runs, ahead = [], []
    for h in range(height):
        tree = Treehash(h)
        for x in leaves[: spans[h + 1]]:
            tree.push(x)
        runs.append(tree.finish())
        ahead.append(Treehash(h))
    path: list[tuple[str, str]] = [("", "")] * height
    for i in range(len(leaves)):
        for h in range(height):
            if i % spans[h]:
                break
            if i and i % spans[h + 1] == 0:
                runs[h], ahead[h] = ahead[h].finish(), Treehash(h)
            at = i // spans[h] % ARITY
            path[h] = ("".join(runs[h][:at]), "".join(runs[h][at + 1 :]))
        yield path
        for h in range(height):
            if (j := i + spans[h + 1]) < len(leaves):
                ahead[h].push(leaves[j])


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


# Positions


def _places(batches):
    """Each row's place among the rows of its part in this partition."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0)
        codes = part.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.ones(len(codes), bool)
        starts[1:] = codes[1:] != codes[:-1]
        heads = np.flatnonzero(starts)
        place = np.arange(len(codes)) - heads[np.cumsum(starts) - 1]
        if part[0].as_py() == last:
            place[: heads[1] if len(heads) > 1 else len(codes)] += n
        last, n = part[len(codes) - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `block` and `at`: the position of each among those of its (non-null) `part` in this order. Two small
    exchanges: the sort, and one number for each partition and part."""
    rows = common.checkpointed(rows)
    dealt = rows.repartitionByRange(common.partitions_for(rows), "part", *order).sortWithinPartitions("part", *order)
    names = [c for c in rows.columns if c != "part"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    local = common.checkpointed(dealt.select("part", *names, F.spark_partition_id().alias("pid")).mapInArrow(_places, f"part string, {kinds}, pid int, place long"))
    counts = local.groupBy("part", "pid").agg(F.count("*").alias("n"))
    # A part has a row here for each partition that it lies in; only in the first of a partition others may come before.
    before = counts.select("pid", "part", F.expr("sum(n) OVER (PARTITION BY part ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before")).filter("before > 0")
    whole = local.join(before, ["pid", "part"], "left").withColumn("position", F.col("place") + F.coalesce("before", F.lit(0)))
    return common.checkpointed(whole.select("part", *names, F.floor(F.col("position") / BLOCK).cast("long").alias("block"), (F.col("position") % BLOCK).cast("int").alias("at")))


# Rounds


def _blocks(batches, n: int):
    """(part, block, columns as lists) of sorted rows, a block at a time; at most BLOCK rows and its header."""
    key, held = None, [[] for _ in range(n)]
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if key:
                    yield *key, held
                key, held = row[:2], [[] for _ in range(n)]
            for column, value in zip(held, row[2:], strict=True):
                column.append(value)
    if key:
        yield *key, held


def _tops(batches):
    for part, block, (_, digests) in _blocks(batches, 2):
        yield pa.RecordBatch.from_pydict({"part": [part], "digest": [bytes.fromhex(top([d.hex() for d in digests], height_of(block, len(digests))))], "position": [block]}, pa.schema([("part", pa.string()), ("digest", pa.binary()), ("position", pa.int64())]))


def _together(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "part", "block").sortWithinPartitions("part", "block", "at")


def _parted(nodes: DataFrame) -> DataFrame:
    return nodes.select("part", "digest", F.floor(F.col("position") / BLOCK).cast("long").alias("block"), (F.col("position") % BLOCK).cast("int").alias("at"))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (part, block, at, digest) of each round, the leaves first; in the last one each part has one node, its root.
    One number of each round reaches the driver: the largest block."""
    out = [nodes]
    while True:
        below = out[-1].select("part", "block", "at", "digest")
        out.append(common.checkpointed(_parted(_together(below, common.partitions_for(below)).mapInArrow(_tops, "part string, digest binary, position long"))))
        if not (below.agg(F.max("block")).first()[0] or 0):
            return out


_PATH = "part string, block long, subroot string, root string, lefts array<string>, rights array<string>"


def _descend(batches):
    """The paths of a block's nodes from the header's, which is that of its top."""
    for part, block, (_, digests, subroots, roots, lefts, rights) in _blocks(batches, 6):
        leaves = [d.hex() for d in digests[1:]]
        out = [(part, block * BLOCK + i, subroots[0], roots[0], [a for a, _ in path] + lefts[0], [b for _, b in path] + rights[0]) for i, path in enumerate(walk(leaves, height_of(block, len(leaves))))]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "block", "subroot", "root", "lefts", "rights"])


def _with_headers(nodes: DataFrame, paths: DataFrame, columns: str) -> DataFrame:
    """Each block's rows after the path of its top, in one partition."""
    header = paths.select("part", "block", F.lit(-1).alias("at"), "subroot", "root", "lefts", "rights")
    both = nodes.unionByName(header, allowMissingColumns=True)
    return _together(both, common.partitions_for(nodes)).select("part", "block", "at", *columns.split(), "subroot", "root", "lefts", "rights")


def descended(levels: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the nodes of the first of these rounds, from those of the roots."""
    for nodes in reversed(levels):
        body = _with_headers(nodes.select("part", "block", "at", "digest"), paths, "digest")
        paths = common.checkpointed(body.mapInArrow(_descend, _PATH))
    return paths


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(batches):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for _, block, (_, digests, ids, others, subroots, roots, lefts, rights) in _blocks(batches, 8):
        leaves = [d.hex() for d in digests[1:]]
        above = list(zip(lefts[0], rights[0], strict=True))
        shared = "".join(a + b for a, b in above)
        out = []
        for i, path in enumerate(walk(leaves, height_of(block, len(leaves)))):
            told = others[i + 1].hex() if others[i + 1] else leaves[i]
            proof = hashlib.sha256(("".join(a + b for a, b in path) + shared).encode()).hexdigest()
            root = folded(folded(told, path), above)
            out.append((ids[i + 1], leaves[i], subroots[0], roots[0], proof, root, root == roots[0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def manifest(docs: DataFrame, fields: list[str], tampered: dict[str, Column] | None = None, when: Column | None = None, id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """The proofs of all rows. Where `when` holds, proofs are folded from the row with the `tampered` columns in place of its
    own. What follows the leaves' digests are ids, parts and digests: no text is exchanged."""
    # Names sort as bytes; null parts come first.
    part = F.coalesce(F.concat(F.lit("1"), F.col(part_col).cast("string")), F.lit("0"))
    columns = {f: F.col(f) for f in fields}
    other = leaf(list((columns | (tampered or {})).values())) if tampered else F.lit(None).cast("binary")
    leaves = docs.select(part.alias("part"), F.col(id_col).cast("long").alias("id"), leaf(list(columns.values())).alias("digest"), F.when(when, other).alias("other") if when is not None else other.alias("other"))
    leaves = placed(leaves, ["id", "digest"])
    own = rounds(leaves)
    subroots = own.pop()
    parts = placed(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), "digest"), ["name"])
    all_rounds = rounds(parts)
    root = all_rounds.pop().select("part", "block", F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    # The place of a part among all is its block in these paths.
    of_places = descended(all_rounds, root).withColumnRenamed("block", "position")
    of_parts = parts.withColumn("position", F.col("block") * BLOCK + F.col("at")).select("name", "position", "digest").join(of_places, "position")
    paths = of_parts.select(F.col("name").alias("part"), F.lit(0).cast("long").alias("block"), F.lower(F.hex("digest")).alias("subroot"), "root", "lefts", "rights")
    paths = descended(own[1:], common.checkpointed(paths))
    body = _with_headers(leaves.select("part", "block", "at", "digest", "id", "other"), paths, "digest id other")
    return body.mapInArrow(_proofs, SCHEMA)
