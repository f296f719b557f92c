"""Byte-level BPE over a corpus by a global shuffle of distinct words.

A task cuts its documents into blocks of about BLOCK_TOKENS words (with the space before them; or runs of white space) and
writes, per block, the sequence of words as positions into the block's own list of distinct words, and that list, dealt to
word shards by hash. Equal words of all blocks meet in one shard, where each is cut into pre-tokens and encoded once (a shard
remembers at most HELD words at a time); the ids go back to the blocks and replace the words by position. Frequent words cost
one entry per block, never one per occurrence, so no shard is hot. Decoding looks every id up in the token-byte table (of
fixed size), once for each distinct word of a block.

Blocks are cut twice from the same scan, once for the words and once for the sequences, which costs less than storing
both; an input that comes out of a shuffle, whose rows have no order, is written first. Either side carries a hash of the
block's words, so a table that changed in between is refused. A text is split at the spaces before words, and the expression
looks only at the distinct pieces of a block. Words of more than LONG characters (scripts without spaces, encoded data) rarely
repeat, so their pre-tokens stand for them.

Defined results: a null or empty text has no ids, and its hashes are those of no bytes; repeated rows each give a row; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common

BLOCK_TOKENS, HELD, LONG = 2_000_000, 600_000, 32

# The white space of the tokenizers' pattern language.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words with their space, and runs of white space, cut where every byte-level pattern cuts too.
_COARSE = regex.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WHITE, _BEFORE_WORD = re.compile(f"[{_SPACE}]"), re.compile(f" (?=[^{_SPACE}])")

_TOOLS: dict[str, tuple] = {}


def tools(name: str) -> tuple:
    """(ids of one of `Block`'s words, bytes of each id, pre-token pattern) of a rank file, kept while the worker lives."""
    if name not in _TOOLS:
        import public_tokenizers
        import tiktoken

        with open(common.tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cut, whole = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (public_tokenizers.PATTERN, r"[\s\S]+"))
        # A run of white space is one pre-token; the pattern's look-ahead overflows the library's stack on long runs.
        _TOOLS[name] = lambda word: whole(word) if word.isspace() else cut(word), {k: b for b, k in ranks.items()}, regex.compile(public_tokenizers.PATTERN)
    return _TOOLS[name]


def _squeeze(x: np.ndarray) -> bytes:
    """Integers, compressed by byte planes."""
    x = np.ascontiguousarray(x, "<u4")
    planes = x.view(np.uint8).reshape(-1, 4).T
    return struct.pack("<Q", len(x)) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _expand(data: bytes) -> np.ndarray:
    n = struct.unpack("<Q", data[:8])[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=4 * n or 1), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    a, b = _squeeze(sizes), zstandard.ZstdCompressor(level=3).compress(b"".join(words))
    return struct.pack("<III", len(a), len(b), int(sizes.sum())) + a + b


def _unpack_words(data: bytes) -> list[bytes]:
    a, b, n = struct.unpack("<III", data[:12])
    ends = np.cumsum(_expand(data[12 : 12 + a])).tolist()
    flat = zstandard.ZstdDecompressor().decompress(data[12 + a : 12 + a + b], max_output_size=n or 1)
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


class Block:
    """Documents of a task, their words as numbers of the block's distinct words."""

    def __init__(self, pattern, only_words: bool):
        self.pattern, self.only_words = pattern, only_words
        self.words: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.docs: list[int | None] = []
        self.sequences: list[bytes] = []
        self.size = 0

    def _cut(self, text: str) -> list[str]:
        words = _COARSE.findall(text)
        if max(map(len, words), default=0) > LONG:
            return [t for w in words for t in (self.pattern.findall(w) if len(w) > LONG and not w.isspace() else (w,))]
        return words

    def _learn(self, pieces: list[str]) -> bool:
        """Numbers the words of new pieces, each with the space before it; a text's first piece, which has none before it, is
        marked by one. False, and nothing done, if a piece begins with white space, so that words cannot be told by piece."""
        cut, known = [], self.words
        for p in pieces:
            at = _WHITE.search(p)
            if not p or at and p[0] != " " and not at.start():
                return False
            plain = at is None and len(p) < LONG
            cut.append(None if plain else self._cut(p[1:] if p[0] == " " else " " + p))
        for p, words in zip(pieces, cut, strict=True):
            if words is None:
                self.pieces[p] = known.setdefault(" " + p, len(known)).to_bytes(4, "little")
            else:
                self.pieces[p] = b"".join([known.setdefault(w, len(known)).to_bytes(4, "little") for w in words])
        return True

    def add(self, doc_id: int | None, text: str | None) -> None:
        held, sequence = self.pieces, b""
        if text:
            pieces = text.split(" ")
            pieces[0] = " " + pieces[0]
            self.size += max(len(pieces), len(text) // 8)
            new = set(pieces).difference(held)
            if new and not self._learn(sorted(new)):
                pieces = _BEFORE_WORD.split(text)
                pieces[0] = " " + pieces[0]
                self._learn(sorted(set(pieces).difference(held)))
            if not self.only_words:
                sequence = b"".join([held[p] for p in pieces])
        if not self.only_words:
            self.docs.append(doc_id)
            self.sequences.append(sequence)

    def rows(self, block: int, shards: int):
        """(block, shard, data): the distinct words of each shard, or else the sequences under shard -1."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.uint32, len(words))
        mark = struct.pack("<II", len(words), zlib.crc32(b"\n".join(words)))
        if self.only_words:
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                own = order[cuts[s] : cuts[s + 1]]
                if len(own):
                    yield block, s, mark + _pack_words([words[k] for k in own.tolist()])
            return
        ids = np.array([x or 0 for x in self.docs], "<i8").tobytes() + np.array([x is not None for x in self.docs], np.uint8).tobytes()
        sizes = _squeeze(np.array([len(s) // 4 for s in self.sequences]))
        flat = _squeeze(np.frombuffer(b"".join(self.sequences), "<u4"))
        where = _squeeze(shard)
        yield block, -1, mark + struct.pack("<IIII", len(self.docs), len(sizes), len(flat), len(where)) + ids + sizes + flat + where


def _batch(rows) -> pa.RecordBatch:
    b, s, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(s, pa.int32()), pa.array(d, pa.binary())], ["block", "shard", "data"])


def _parts(rows, most: int = 8 << 20):
    """Batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def blocks(docs: DataFrame, name: str, shards: int, only_words: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        pattern, n = tools(name)[2], 0
        part = TaskContext.get().partitionId() << 24
        block = Block(pattern, only_words)
        for batch in common.parts(batches, 500):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.add(doc_id, text)
                if block.size >= BLOCK_TOKENS:
                    yield from _parts(block.rows(part + n, shards))
                    block, n = Block(pattern, only_words), n + 1
        if block.size or block.docs:
            yield from _parts(block.rows(part + n, shards))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, shard int, data binary")


def encode_words(words: DataFrame, name: str, shards: int) -> DataFrame:
    """The ids of each block's words, per shard: counts and ids in the order of the words. Rows stream through a shard."""

    def run(batches):
        encode = tools(name)[0]
        known: dict[bytes, tuple] = {}

        def rows():
            for batch in common.parts(batches, 500):
                for block, shard, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    got = []
                    for w in _unpack_words(data[8:]):
                        ids = known.get(w)
                        if ids is None:
                            if len(known) >= HELD:
                                known.clear()
                            ids = known[w] = tuple(encode(w.decode("utf-8", "surrogatepass")))
                        got.append(ids)
                    a = _squeeze(np.fromiter(map(len, got), np.uint32, len(got)))
                    b = _squeeze(np.fromiter(chain.from_iterable(got), np.uint32))
                    yield block, shard, data[:8] + struct.pack("<I", len(a)) + a + b

        yield from _parts(rows())

    return words.repartition(shards, "shard").mapInArrow(run, "block long, shard int, data binary")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sequence(data: bytes):
    n, a, b, c = struct.unpack("<IIII", data[:16])
    at = 16
    ids = np.frombuffer(data[at : at + 8 * n], "<i8").tolist()
    known = data[at + 8 * n : at + 9 * n]
    at += 9 * n
    sizes, flat, where = _expand(data[at : at + a]), _expand(data[at + a : at + a + b]), _expand(data[at + a + b : at + a + b + c])
    return [i if k else None for i, k in zip(ids, known, strict=True)], sizes, flat, where


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs of these starts and sizes, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _word_ids(where: np.ndarray, shards: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each word, as a number; all of them) of a block's words, put back into the block's order."""
    parts = []
    for _, data in sorted(shards.items()):
        a = struct.unpack("<I", data[:4])[0]
        parts.append((_expand(data[4 : 4 + a]), _expand(data[4 + a :])))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.empty(len(where), np.int64)
    order = np.argsort(where, kind="stable")
    count[order] = sizes
    out = np.empty(len(ids), np.uint32)
    out[_gather((np.cumsum(count) - count)[order], sizes.astype(np.int64))] = ids
    return count, out


def assemble(sequences: DataFrame, ids: DataFrame, name: str, each, schema: str) -> DataFrame:
    """Joins a block's sequences with its words' ids. each(doc_ids, sizes, flat, count, ids, bytes_of) gives a record
    batch, with the number of ids of each word and all of them."""

    def run(key, left, right):
        table = tools(name)[1]
        rows = left.column("data").to_pylist()
        shards = dict(zip(right.column("shard").to_pylist(), right.column("data").to_pylist(), strict=True))
        mark = rows[0][:8] if rows else None
        if len(rows) != 1 or any(d[:8] != mark for d in shards.values()):
            raise RuntimeError("the input changed between the two scans of a block")
        doc_ids, sizes, flat, where = _sequence(rows[0][8:])
        return pa.Table.from_batches([each(doc_ids, sizes, flat, *_word_ids(where, {s: d[8:] for s, d in shards.items()}), table)])

    return sequences.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, schema)


def _joined(parts: list, count: np.ndarray, between) -> list[bytes]:
    """The parts of each word, joined."""
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + len(between))))
    ends = ends[np.concatenate(([0], np.cumsum(count)))].tolist()
    whole = between.join(parts)
    whole = whole.encode() if isinstance(whole, str) else whole
    return [whole[i : j - len(between)] for i, j in zip(ends, ends[1:])]


def _digests(doc_ids, sizes, flat, count, ids, table):
    ids = ids.tolist()
    said, spoken = _joined(list(map(str, ids)), count, ","), _joined(list(map(table.__getitem__, ids)), count, b"")
    total = np.concatenate(([0], np.cumsum(count[flat])))
    ends = np.cumsum(sizes)
    rows = []
    for doc_id, n, end in zip(doc_ids, sizes.tolist(), ends.tolist(), strict=True):
        own = flat[end - n : end].tolist()
        if n > 1:
            pick = itemgetter(*own)
            a, b = b",".join(pick(said)), b"".join(pick(spoken))
        else:
            a, b = b"".join([said[k] for k in own]), b"".join([spoken[k] for k in own])
        rows.append((doc_id, int(total[end] - total[end - n]), hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _lists(doc_ids, sizes, flat, count, ids, table):
    total = np.concatenate(([0], np.cumsum(count[flat])))
    offsets = total[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
    values = ids[_gather((np.cumsum(count) - count)[flat], count[flat])]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], ["doc_id", "ids"])


def _encoded(docs: DataFrame, name: str, each, schema: str, id_col: str, text_col: str) -> DataFrame:
    shards = common.partitions_for(docs, 0.5)
    docs = common.stable(docs.select(id_col, text_col))
    words = blocks(docs, name, shards, True, id_col, text_col)
    sequences = blocks(docs, name, shards, False, id_col, text_col).select("block", "data")
    return assemble(sequences, encode_words(words, name, shards), name, each, schema)


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    return _encoded(docs, name, _lists, "doc_id long, ids array<int>", id_col, text_col)


def decode(ids: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids): every id looked up in the token-byte table."""

    def run(batches):
        table = tools(name)[1]
        for batch in common.parts(batches, 500):
            data = [b"".join([table[i] for i in x or []]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and hashes of the ids and of what they decode to, one row per input row."""
    return _encoded(docs, name, _digests, SCHEMA, id_col, text_col)
