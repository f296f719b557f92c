"""Which quotes stand in which texts, for any number and size of either, in one pass over the texts.

A quote is found by an anchor: a hashed gram of bytes (UTF-8 parts no character from its neighbours, so that bytes decide).
Long quotes are anchored at grams that are the smallest of nine in a row, which any text that holds the quote must show as
well; so a text shows a fifth of its grams. Of a quote's own anchors the one that the fewest quotes share is taken, so that
quotes with one beginning don't meet under it. Shorter quotes show every gram, the shortest ones are their own gram.

Each text is hashed once and only grams that a Bloom filter of the anchors lets through are looked at. Quotes of a counted
small size go to every task, which verifies and is done. Beyond it only the filter does, whose size has a bound: a text sends
the stretch around each gram that passes, as long as quotes of that anchor's class may be, to where the anchor's quotes
are. What is exchanged are the quotes and stretches about their size for each place where they may stand, never the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import shared_folder

#: Bytes of distinct quotes that may go to every task, and the most bits of the filter (8 MB).
SMALL_BYTES, FILTER_BITS = 4 << 20, 1 << 26
#: Bits of the filter for each anchor while it has room, and how many of them an anchor sets.
BITS_EACH, BITS_SET = 32, 4
#: Grams and windows: quotes of LONG bytes or more have WINDOW grams of GRAM bytes.
GRAM, WINDOW, SHORT = 16, 9, 8
LONG = GRAM + WINDOW - 1
#: Texts are hashed in pieces of so many bytes.
PIECE = 1 << 20

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def class_of(n: int) -> int:
    """The class of a quote of n bytes: its length below SHORT, else one for every doubling."""
    if n < SHORT:
        return n
    return SHORT + (n >= 2 * SHORT) if n < LONG else SHORT + n.bit_length() - 3


def shape_of(kind: int) -> tuple[int, int, int]:
    """Gram, window and the longest quote of a class."""
    if kind < SHORT:
        return kind, 1, kind
    if kind < SHORT + 2:
        return SHORT, 1, (2 * SHORT, LONG)[kind - SHORT] - 1
    return GRAM, WINDOW, (1 << (kind - SHORT + 3)) - 1


def hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each gram: polynomials, put together from halves."""
    if len(data) < gram:
        return np.empty(0, np.uint64)
    whole, size, power = None, 0, data.astype(np.uint64) + np.uint64(1)
    width, factor, left = 1, _BASE, gram
    while left:  # the binary digits of the gram's length, the lowest first
        if left & 1:
            whole = power if whole is None else whole[: len(data) - size - width + 1] * factor + power[size : size + len(data) - size - width + 1]
            size += width
        left >>= 1
        if left:
            power = power[: len(power) - width] * factor + power[width:]
            width, factor = 2 * width, np.uint64(int(factor) ** 2 % 2**64)
    out = whole[: len(data) - gram + 1]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest or largest of every `width` in a row, put together from halves."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def shown(keys: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the smallest of some whole window."""
    if window == 1:
        return np.arange(len(keys))
    if len(keys) < window:
        return np.empty(0, np.int64)
    # Of the windows over a place the one with the largest minimum tells.
    edge = np.zeros(window - 1, np.uint64)
    most = _extreme(np.concatenate((edge, _extreme(keys, window, np.minimum), edge)), window, np.maximum)
    return np.flatnonzero(most == keys)


def salted(keys: np.ndarray, kind: int) -> np.ndarray:
    """The keys of a class: a gram may anchor quotes of several."""
    return keys * _MIX + np.uint64(kind)


def _anchor_rows(batches):
    for batch in batches:
        out: list[tuple] = []
        for digest, quote in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kind = class_of(len(quote))
            gram, window, _ = shape_of(kind)
            keys = hashes(np.frombuffer(quote, np.uint8), gram) if gram else np.zeros(1, np.uint64)
            out += [(digest, kind, k) for k in np.unique(salted(keys[shown(keys, window)], kind)).view(np.int64).tolist()]
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int64()), strict=True)], ["digest", "kind", "key"])


def anchors(distinct: DataFrame) -> DataFrame:
    """(digest, kind, key): the anchor of each distinct quote, the one that the fewest quotes have."""
    rows = distinct.mapInArrow(_anchor_rows, "digest binary, kind int, key long")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    return rows.join(counted, "key").groupBy("digest").agg(F.min(F.struct("n", "key")).alias("least"), F.first("kind").alias("kind")).select("digest", "kind", F.col("least.key").alias("key"))


def _bits(keys: np.ndarray, size: int) -> list[np.ndarray]:
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return [((keys + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(BITS_SET)]


def bloom(found: DataFrame, n: int) -> np.ndarray:
    """The filter as bytes, at most FILTER_BITS / 8: executors set bits, and what reaches the driver is the words that have any."""
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (BITS_EACH * n).bit_length()))

    def places(batches):
        for batch in batches:
            bits = np.unique(np.concatenate(_bits(np.asarray(batch.column(0)).view(np.uint64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(bits)], ["bit"])

    words = found.select("key").mapInArrow(places, "bit long").groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 31)))").alias("bits"))
    rows = words.toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[np.asarray(rows.column("word").combine_chunks())] = np.asarray(rows.column("bits").combine_chunks()).astype(np.uint32)
    return out


def passing(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    left = np.arange(len(keys))
    for k in range(BITS_SET):  # few are left after the first
        bit = _bits(keys[left], 32 * len(held))[k]
        left = left[(held[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1]
    return left


def looked_at(texts: list[bytes], kinds: list[int], held: np.ndarray):
    """Arrays (text, key, place) for each class: the grams of these texts that the filter lets through. Texts are hashed one
    after the other as one buffer; grams over an end are left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    shapes: dict[tuple[int, int], list[int]] = {}
    for kind in kinds:
        shapes.setdefault(shape_of(kind)[:2], []).append(kind)
    for (gram, window), of in shapes.items():
        if not gram:
            yield 0, np.arange(len(texts)), np.full(len(texts), salted(np.zeros(1, np.uint64), 0).view(np.int64)[0]), np.zeros(len(texts), np.int64)
            continue
        reach = gram + window - 1
        for start in range(0, max(1, len(data) - gram + 1), PIECE):
            keys = hashes(data[start : start + PIECE + 2 * reach], gram)
            # Windows over an end show grams that a text needn't show, and hide none.
            places = shown(keys, window)
            keys, places = keys[places], places + start
            for kind in of:
                own = salted(keys, kind)
                k = passing(own, held)
                text = np.searchsorted(ends, places[k], side="right")
                k, text = (x[places[k] + gram <= ends[np.minimum(text, len(ends) - 1)]] for x in (k, text))
                yield kind, text, own[k].view(np.int64), places[k] - np.append(0, ends)[text]


def _texts(batches):
    """(ids, places of the texts that aren't null, those texts) in parts of bounded size."""
    for batch in batches:
        first, sizes = 0, pc.binary_length(batch.column(1)).to_pylist()
        while first < batch.num_rows:
            size, stop = 0, first
            while stop < batch.num_rows and stop - first < 2000 and (stop == first or size <= PIECE):
                size += int(sizes[stop] or 0)
                stop += 1
            held = [(i, t) for i, t in enumerate(batch.column(1).slice(first, stop - first).to_pylist()) if t is not None]
            if held:
                at, texts = zip(*held, strict=True)
                yield batch.column(0).slice(first, stop - first), np.array(at), list(texts)
            first = stop


def _stretches(kinds: list[int], held):
    """For each text the stretches around grams that the filter lets through, each once."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for ids, where, texts in _texts(batches):
            own = set()
            for kind, *found in looked_at(texts, kinds, held.value):
                reach = shape_of(kind)[2]
                own.update((t, key, texts[t][max(0, at - reach) : at + reach]) for t, key, at in zip(*(x.tolist() for x in found), strict=True))
            at, key, piece = zip(*sorted(own), strict=True) if own else ([],) * 3
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where[at])), pa.array((part << 40) + n + at), pa.array(key, pa.int64()), pa.array(piece, pa.binary())], ["__id", "row", "key", "piece"])
            n += len(texts)

    return run


def _verified(kinds: list[int], held, quotes):
    """For each text the digests of the quotes that it holds, from quotes that are all here."""

    def run(batches):
        for ids, where, texts in _texts(batches):
            asked = {(t, key) for _, text, key, _ in looked_at(texts, kinds, held.value) for t, key in zip(text.tolist(), key.tolist(), strict=True)}
            own = sorted({(t, digest) for t, key in asked for digest, quote in quotes.value.get(key, ()) if quote in texts[t]})
            at, digest = zip(*own, strict=True) if own else ([],) * 2
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where[np.array(at, np.int64)])), pa.array(digest, pa.binary())], ["__id", "digest"])

    return run


def containing(texts: DataFrame, id_col: str, text_col: str, quotes: DataFrame, quote_col: str, small_bytes: int | None = None) -> DataFrame:
    """(id, columns of quotes): each row of texts with each row of quotes whose quote stands in its text. An empty quote
    stands in every text that isn't null; null texts and quotes match nothing; repeated rows count each."""
    spark = texts.sparkSession
    kind_of_id = texts.schema[id_col].dataType.simpleString()
    keyed = quotes.filter(F.col(quote_col).isNotNull()).withColumn("__digest", F.unhex(F.sha2(F.col(quote_col).cast("string").cast("binary"), 256)))
    distinct = keyed.groupBy("__digest").agg(F.first(F.col(quote_col).cast("string").cast("binary")).alias("quote")).withColumnRenamed("__digest", "digest")
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("quote")), F.lit(0)).alias("bytes")).first()
    rows = texts.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores:  # an input of few splits is dealt out first
        rows = rows.repartition(cores)
    # Written once: the filter, the classes and the exchange read it.
    path = shared_folder(spark)
    anchors(distinct).join(distinct, "digest").write.parquet(path)
    found = spark.read.parquet(path)
    kinds = sorted(r.kind for r in found.select("kind").distinct().collect())  # one for each doubling of length
    held = spark.sparkContext.broadcast(bloom(found, size["n"]))
    if size["bytes"] + 64 * size["n"] <= (SMALL_BYTES if small_bytes is None else small_bytes):
        by_key: dict[int, list] = {}
        for r in found.collect():
            by_key.setdefault(r.key, []).append((hashlib.sha256(r.quote).digest(), bytes(r.quote)))
        met = rows.mapInArrow(_verified(kinds, held, spark.sparkContext.broadcast(by_key)), f"__id {kind_of_id}, digest binary")
    else:
        pieces = rows.mapInArrow(_stretches(kinds, held), f"__id {kind_of_id}, row long, key long, piece binary")
        met = pieces.join(found.select("digest", "key", "quote"), "key").filter(F.contains("piece", "quote")).select("__id", "row", "digest").distinct()
    out = met.select("__id", F.col("digest").alias("__digest")).join(keyed, "__digest")
    return out.select(F.col("__id").alias(id_col), *quotes.columns)
