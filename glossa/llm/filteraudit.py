"""Filter interaction audit: what five quality filters remove in every order, alone and after one another.

Each document gets a mask of the filters that it fails. Four are functions of its text; the fifth, being a later copy, comes
from a sort: rows are dealt by ranges of (text fingerprint, doc_id), sorted by (fingerprint, whole text, doc_id), and each is
compared with the row before it. A run of equal texts that goes on in the next partitions is told by its smallest doc_id,
which every partition reports for the fingerprints at its two borders; so a text that a third of all rows hold lies in many
partitions. Ranges leave the whole text out, because Spark draws a sample of the range keys to the driver; texts that only
share a fingerprint are told apart by the sort and, at borders, by SHA-256.

The masks are then added up for each part: counts by mask are all that the 120 orders need. A filter removes a document in as
many of the orders as it comes first in among the filters that the document fails.

Defined results: a null text is an empty one, a null part the empty string; a row without doc_id is no copy and makes none;
rows that repeat a doc_id with the same text are no copies of each other; a doc_id counts as good or toxic if any label row
says so, for each row that has it. An empty table has no parts.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import common

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 50, 65, 5
SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def text_failures(text: Column) -> Column:
    """The mask of the filters that look at one text: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def mask(pair: Column) -> Column:
        total, distinct = pair["total"], pair["distinct"]
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        failed = (total < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * total, 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text), text.rlike(SYMBOLS))
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))

    # The words are cut once: both counts come from one element of an array.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("total"), F.size(F.array_distinct(w)).alias("distinct")))
    return F.element_at(F.transform(counts, mask), 1)


_SORTED = "doc_id long, part string, fails int, pid int, print long, digest binary, first long"


def _against_predecessor(batches):
    """Rows of one sorted partition with the copy filter's bit. Rows under the partition's first fingerprint also say which
    text they hold; at the end come records (null fails) of the smallest doc_id of each text under the first and last one."""
    prior = None  # (fingerprint, text, smallest id) of the row before
    opening, held = None, {}  # the first fingerprint; digest to smallest id under the present one
    records, pid = {}, 0
    for whole in batches:
        for batch in common.parts([whole], 4096):
            if not batch.num_rows:
                continue
            ids, fails, prints = (np.asarray(batch.column(k)) for k in (0, 2, 4))
            text, pid = batch.column(5), batch.column(3)[0].as_py()
            if opening is None:
                opening = int(prints[0])
            starts = np.ones(len(ids), bool)
            starts[1:] = (prints[1:] != prints[:-1]) | np.asarray(pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False), bool)
            if prior and prior[0] == prints[0] and prior[1] == text[0].as_py():
                starts[0] = False
            heads = np.flatnonzero(starts)
            group = np.cumsum(starts) - 1
            first = np.where(group >= 0, ids[heads[group]] if len(heads) else 0, prior[2] if prior else 0)
            copies = ids > first
            for at in heads:  # a text that starts under a border's fingerprint
                mark = int(prints[at])
                if mark in (opening, int(prints[-1])):
                    if mark not in held:
                        if opening in held:
                            records[opening] = held[opening]
                        held = {mark: {}}
                    held[mark].setdefault(hashlib.sha256(text[int(at)].as_py()).digest(), int(ids[at]))
            at_border = prints == opening
            digests: list[bytes | None] = [None] * len(ids)
            for k in np.flatnonzero(at_border):
                digests[k] = digests[k - 1] if k and not starts[k] and digests[k - 1] else hashlib.sha256(text[int(k)].as_py()).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fails | np.where(copies, COPY, 0).astype(np.int32), pa.int32()), batch.column(3), pa.array(prints, pa.int64(), mask=~at_border), pa.array(digests, pa.binary()), pa.nulls(len(ids), pa.int64())],
                ["doc_id", "part", "fails", "pid", "print", "digest", "first"],
            )
            prior = (int(prints[-1]), text[len(ids) - 1].as_py(), int(first[-1]))
    if opening is not None:
        records |= held
        rows = [(mark, digest, first) for mark, texts in records.items() for digest, first in texts.items()]
        marks, digests, firsts = zip(*rows, strict=True)
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array(marks, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.int64())],
            ["doc_id", "part", "fails", "pid", "print", "digest", "first"],
        )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, fails): the filters each row fails, as bits in the order of FILTERS. One exchange of the texts; all
    that follows are ids, parts and masks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull()).withColumn("print", F.xxhash64("text"))
    placed = known.repartitionByRange(common.partitions_for(docs), "print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    judged = placed.select("doc_id", "part", text_failures(F.col("text")).alias("fails"), F.spark_partition_id().alias("pid"), "print", F.col("text").cast("binary").alias("text"))
    seen = common.checkpointed(judged.mapInArrow(_against_predecessor, _SORTED))
    records = seen.filter(F.col("fails").isNull()).select("pid", "print", "digest", "first")
    least = records.groupBy("print", "digest").agg(F.min("first").alias("least"))
    earlier = records.join(least, ["print", "digest"]).filter(F.col("least") < F.col("first")).select("pid", "digest", F.lit(True).alias("earlier"))
    judged = seen.filter(F.col("fails").isNotNull())
    inner = judged.filter(F.col("digest").isNull()).select("doc_id", "part", "fails")
    # All rows of a text that started in an earlier partition come after its smallest doc_id.
    border = judged.filter(F.col("digest").isNotNull()).join(earlier, ["pid", "digest"], "left")
    border = border.select("doc_id", "part", F.when(F.col("earlier"), F.col("fails").bitwiseOR(F.lit(COPY))).otherwise(F.col("fails")).alias("fails"))
    nameless = rows.filter(F.col("doc_id").isNull()).select("doc_id", "part", text_failures(F.col("text")).alias("fails"))
    return inner.unionAll(border).unionAll(nameless)


def counters(failed: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, fails, n, good, toxic): how many rows of each part have each mask. Counters of two tables may be added."""
    counted = failed.select("part", "fails", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic")).groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    if labels is not None:
        flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
        marked = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic")).filter("good + toxic > 0")
        lost = failed.join(marked, "doc_id").groupBy("part", "fails").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        counted = counted.unionAll(lost).groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    return counted


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters: each part's are gathered to arrays of 32 (by mask)
    and 600 rows are looked up from sums of these."""
    masks = F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))
    by_mask = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("fails", F.struct("n", "good", "toxic").alias("of")))).alias("held"))

    def gathered(counts: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.try_element_at("held", m)[counts], F.lit(0).cast("long"))).alias(counts)

    arrays = by_mask.select("part", *(gathered(c) for c in ("n", "good", "toxic")))

    def clear(counts: str) -> Column:
        """For each set of filters: the documents that fail none of it."""
        return F.transform(masks, lambda s: F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(s) == 0, F.element_at(counts, m + 1)).otherwise(0)))

    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    # How many of all orders put a filter first among k.
    firsts = [0, *(len(orders) // k for k in range(1, len(FILTERS) + 1))]
    shapley = lambda bit: F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(bit) != 0, F.element_at("n", m + 1) * F.element_at(F.lit(firsts), F.bit_count(m) + 1)).otherwise(0))
    bits = F.lit([1 << k for k in range(len(FILTERS))])
    sums = arrays.select("part", "n", *(clear(c).alias(f"clear_{c}") for c in ("n", "good", "toxic")), F.transform(bits, shapley).alias("share"))
    rows = sums.select("*", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letters = lambda upto: F.aggregate(F.filter(F.split(F.col("filter_order").substr(F.lit(1), upto), ""), lambda x: x != ""), F.lit(0), lambda a, x: a + F.element_at(bits, F.instr(F.lit(FILTERS), x)))
    rows = rows.withColumn("upto", letters(F.col("step"))).withColumn("before", letters(F.col("step") - 1)).withColumn("bit", F.col("upto") - F.col("before"))
    at = lambda counts, s: F.element_at(counts, F.col(s) + 1 if isinstance(s, str) else s + 1)
    left, was = at("clear_n", "upto"), at("clear_n", "before")
    failing = at("clear_n", F.lit(0)) - at("clear_n", "bit")
    return rows.select(
        "part", "filter_order", "step", left.alias("kept"), (was - left).alias("removed"), (failing - (was - left)).alias("redundant"), at("n", "bit").alias("unique_fails"),
        (at("clear_good", "before") - at("clear_good", "upto")).alias("good_lost"), (at("clear_toxic", "before") - at("clear_toxic", "upto")).alias("toxic_lost"),
        F.element_at("share", F.instr(F.lit(FILTERS), F.col("filter_order").substr(F.col("step"), F.lit(1)))).alias("shapley"),
    )
