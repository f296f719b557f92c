"""Token ids in seekable zstandard files.

A file holds one independent frame per document (its ids as little-endian unsigned integers of 2 or 4 bytes), then a frame
that is the index (item size, document ids, token counts), then the trailing seek table of the public zstandard seekable
format: a skippable frame with, for each frame, its stored size, its plain size and the low 32 bits of the XXH64 of its
plain bytes. A reader takes the table from the file's end and decompresses only the frames it wants; any zstandard tool
can decompress the whole file.

Files are ranges of doc_id in ascending order (ties by text), each written to a temporary name in the shared folder and
then renamed, so a task that runs again writes the same file in the old one's place. Rows without id are spread over files
by a hash of their text. Only (file, documents, tokens) rows reach the driver, one
per task.

Defined results: a null text is the end id alone; rows without doc_id come first, in the order of that hash; repeated rows are all written; an empty
table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common, wordbpe

# Fixed values of the format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

LEVEL, END_ID = 3, 2


class Damaged(ValueError):
    """A file's bytes contradict its seek table."""


def write_file(docs, item: int = 2):
    """The file's bytes, in parts, from (doc_id or None, ids as little-endian uint32 bytes)."""
    tool = zstandard.ZstdCompressor(level=LEVEL)
    table, ids, sizes = [], [], []

    def frame(data: bytes) -> bytes:
        stored = tool.compress(data)
        table.append((len(stored), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return stored

    for doc_id, tokens in docs:
        values = np.frombuffer(tokens, "<u4")
        if item == 2 and len(values) and values.max() > 0xFFFF:
            raise ValueError("an id is too large for two bytes")
        ids.append(doc_id)
        sizes.append(len(values))
        yield frame((values.astype("<u2") if item == 2 else values).tobytes())
    known = np.array([x is not None for x in ids], np.uint8)
    index = struct.pack("<II", item, len(ids)) + known.tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + np.array(sizes, "<u4").tobytes()
    yield frame(index)
    body = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    yield struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class Reader:
    """Random access to a file object that can seek."""

    def __init__(self, file, size: int):
        self.file, self.tool = file, zstandard.ZstdDecompressor()
        self._at(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise Damaged("no seek table")
        self._at(size - 9 - 12 * count - 8)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE_MAGIC, 12 * count + 9):
            raise Damaged("the seek table has another size")
        table = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3)
        self.stored, self.plain, self.sums = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.stored)))
        if self.starts[-1] != size - 17 - 12 * count:
            raise Damaged("frames are missing")
        index = self.frame(count - 1)
        self.item, n = struct.unpack("<II", index[:8])
        known = np.frombuffer(index[8 : 8 + n], np.uint8)
        ids = np.frombuffer(index[8 + n : 8 + 9 * n], "<i8")
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.sizes = np.frombuffer(index[8 + 9 * n :], "<u4").astype(np.int64)

    def _at(self, k: int) -> None:
        if k < 0:
            raise Damaged("the file is too short")
        self.file.seek(k)

    def frame(self, k: int) -> bytes:
        self._at(int(self.starts[k]))
        data = self.tool.decompress(self.file.read(int(self.stored[k])), max_output_size=int(self.plain[k]) or 1)
        if len(data) != self.plain[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise Damaged(f"frame {k} fails its checksum")
        return data

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document; no other document is decompressed."""
        return np.frombuffer(self.frame(k), "<u2" if self.item == 2 else "<u4").astype("<u4")


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def replace(store, held: str, target: str) -> None:
    """Renames a file; one that an earlier run of the task left there goes first (some file systems don't rename onto it)."""
    from pyarrow import fs

    if store.get_file_info(target).type != fs.FileType.NotFound:
        store.delete_file(target)
    store.move(held, target)


def write(docs: DataFrame, folder: str | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes the files and returns (address, documents, tokens) of each in order of doc_id."""
    folder = folder or common.shared_folder(docs.sparkSession)

    def run(batches):
        tool, end = wordbpe.encoder(vocabulary), end_id.to_bytes(4, "little")
        part, tokens, count = TaskContext.get().partitionId(), 0, 0
        name = f"{folder}/part-{part:06d}.tokens.zst"

        def rows():
            nonlocal tokens, count
            for batch in common.parts(batches, 500):
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = tool.encode(text) + end
                    tokens += len(ids) // 4
                    count += 1
                    yield doc_id, ids

        own = rows()
        first = next(own, None)
        if first is None:
            return
        store, path = _opened(folder)
        store.create_dir(path, recursive=True)
        held, target = f"{path}/.{uuid.uuid4().hex}", f"{path}/part-{part:06d}.tokens.zst"

        def again():
            yield first
            yield from own

        with store.open_output_stream(held, compression=None) as out:
            for piece in write_file(again(), 4 if max(tool.size, end_id + 1) > 1 << 16 else 2):
                out.write(piece)
        replace(store, held, target)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([count], pa.int64()), pa.array([tokens], pa.int64())], ["part", "file", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie")
    ranged = rows.select("doc_id", tie, "text").repartitionByRange(common.partitions_for(docs, 0.5), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    got = ranged.mapInArrow(run, "part int, file string, docs long, tokens long").collect()
    return [(r.file, r.docs, r.tokens) for r in sorted(got, key=lambda r: r.part)]


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document of the files: where its ids start among all, how many they are, and their crc32."""
    start, rows = 0, []
    for name, _, tokens in files:
        rows.append((name, start))
        start += tokens

    def run(batches):
        for batch in common.parts(batches, 500):
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = _opened(name)
                with store.open_input_file(path) as f:
                    reader = Reader(f, f.size())
                    starts = base + np.cumsum(reader.sizes) - reader.sizes
                    for k in range(0, len(reader.doc_ids), 4096):
                        at = range(k, min(k + 4096, len(reader.doc_ids)))
                        ids = [reader.ids(j) for j in at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([reader.doc_ids[j] for j in at], pa.int64()), pa.array(starts[k : k + len(ids)]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    names = spark.createDataFrame(rows, "file string, start long")
    return names.repartition(max(1, len(rows))).mapInArrow(run, SCHEMA)
