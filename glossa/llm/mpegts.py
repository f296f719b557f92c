"""Media columns: byte payloads stored as MPEG transport streams (ISO/IEC 13818-1).

A payload is cut into access units, each carried by one packetised elementary packet (private stream 1) with a
presentation time stamp. Every access unit starts its own transport packet with a clock reference; every GROUP-th one is
a random-access point, announced by fresh program tables (PAT, PMT with their CRC-32). Reading parses the tables, checks
the continuity counters of all three PIDs, reassembles the elementary packets and lists the time stamps.

Defined results: a null text is an empty one; the payload is never empty (it is filled up with bytes 255 to a positive
multiple of 576); equal texts give equal streams, since nothing but the payload enters them. One row per input row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm import common

# Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, STREAM_ID, PRIVATE_TYPE, CLOCK = 188, 0x47, 0, 0x1000, 0x100, 0xBD, 0x06, 90_000

UNIT = 576
#: Payload bytes of an access unit, access units of a random-access group, and clock ticks an access unit lasts.
AU_BYTES, GROUP, TICKS = 8 * UNIT, 8, CLOCK // 25


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    section += struct.pack(">I", section_crc(section))
    body = b"\0" + section  # pointer field
    return struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter) + body + b"\xff" * (PACKET - 4 - len(body))


def _tables() -> list[bytes]:
    """For each counter value the PAT packet followed by the PMT packet."""
    pat = struct.pack(">BHHBBBHH", 0, 0xB000 | 13, 1, 0xC1, 0, 0, 1, 0xE000 | PMT_PID)
    pmt = struct.pack(">BHHBBBHHBHH", 2, 0xB000 | 18, 1, 0xC1, 0, 0, 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000)
    return [_table_packet(PAT_PID, k, pat) + _table_packet(PMT_PID, k, pmt) for k in range(16)]


_TABLES = _tables()


def _pts(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1])


def _pcr(t: int) -> bytes:
    t &= (1 << 33) - 1
    return struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose size is a positive multiple of UNIT."""
    out, counter = [], 0
    for k in range(0, max(1, -(-len(payload) // AU_BYTES))):
        unit = payload[k * AU_BYTES : (k + 1) * AU_BYTES]
        stamp = (k + 1) * TICKS
        access = k % GROUP == 0
        if access:
            out.append(_TABLES[(k // GROUP) % 16])
        data = b"\0\0\1" + bytes([STREAM_ID]) + struct.pack(">H", len(unit) + 8) + b"\x80\x80\x05" + _pts(stamp) + unit
        rest = len(data) - 176
        n = 1 + -(-rest // 184)
        block = np.full((n, PACKET), 0xFF, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        block[0, 3] |= 0x20
        block[0, 4:12] = np.frombuffer(b"\x07" + (b"\x50" if access else b"\x10") + _pcr(k * TICKS), np.uint8)
        flat = np.frombuffer(data, np.uint8)
        block[0, 12:] = flat[:176]
        full, tail = divmod(rest, 184)
        if full:
            block[1 : 1 + full, 4:] = flat[176 : 176 + full * 184].reshape(full, 184)
        if tail:  # stuffing in an adaptation field
            gap = 184 - tail
            block[-1, 3] |= 0x20
            block[-1, 4] = gap - 1
            if gap > 1:
                block[-1, 5] = 0
            block[-1, 4 + gap :] = flat[-tail:]
        counter = (counter + n) & 15
        out.append(block.tobytes())
    return b"".join(out)


class BrokenStream(ValueError):
    """The bytes are no whole transport stream."""


def _section(packet: np.ndarray, table: int) -> bytes:
    body = packet[4:].tobytes()
    body = body[1 + body[0] :]
    size = 3 + (struct.unpack(">H", body[1:3])[0] & 0x0FFF)
    if body[0] != table or section_crc(body[:size]):
        raise BrokenStream("a program table is damaged")
    return body[:size]


def _same(packets: np.ndarray) -> np.ndarray:
    """One of a stream's packets of a program table; all of them say the same, so that the checksum of one holds for all."""
    if (packets[:, 4:] != packets[0, 4:]).any():
        raise BrokenStream("program tables differ")
    return packets[0]


def demux(stream: bytes) -> tuple[bytes, dict]:
    """The payload and what the stream says about it: stamps, random-access points (packet numbers) and counts."""
    if not stream or len(stream) % PACKET:
        raise BrokenStream("not whole packets")
    a = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (a[:, 0] != SYNC).any():
        raise BrokenStream("a sync byte is missing")
    pid = ((a[:, 1].astype(np.int32) & 0x1F) << 8) | a[:, 2]
    pats = np.flatnonzero(pid == PAT_PID)
    if not len(pats):
        raise BrokenStream("no program table")
    pmt_pid = struct.unpack(">H", _section(_same(a[pats]), 0)[10:12])[0] & 0x1FFF
    pmts = np.flatnonzero(pid == pmt_pid)
    if not len(pmts):
        raise BrokenStream("no program map")
    pmt = _section(_same(a[pmts]), 2)
    kind, es_pid = pmt[12], struct.unpack(">H", pmt[13:15])[0] & 0x1FFF
    own = np.flatnonzero(pid == es_pid)
    for at in (pats, pmts, own):
        counters = a[at, 3].astype(np.int16) & 15
        if ((np.diff(counters) & 15) != 1).any():
            raise BrokenStream("a packet is missing or doubled")
    b = a[own]
    extended = (b[:, 3] & 0x20) != 0
    begin = np.where(extended, 5 + b[:, 4].astype(np.int32), 4)
    size = PACKET - begin
    data = b[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))
    starts = np.flatnonzero(b[:, 1] & 0x40)
    flags = np.where(extended & (b[:, 4] > 0), b[:, 5], 0)
    units, stamps = [], []
    for k, first in enumerate(starts):
        at = int(ends[first])
        end = int(ends[starts[k + 1]]) if k + 1 < len(starts) else int(ends[-1])
        if data[at : at + 3] != b"\0\0\1" or data[at + 3] != STREAM_ID:
            raise BrokenStream("an elementary packet does not start where it should")
        if struct.unpack(">H", data[at + 4 : at + 6])[0] != end - at - 6:
            raise BrokenStream("an elementary packet is cut short")
        p = data[at + 9 : at + 14]
        stamps.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        units.append(data[at + 9 + data[at + 8] : end])
    access = own[(flags & 0x40) != 0]
    return b"".join(units), {"packets": len(a), "type": kind, "pts": stamps, "random_access": [int(x) for x in access]}


def padded(text: bytes | None) -> bytes:
    text = text or b""
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (size - len(text))


def features(payload: bytes, seen: dict) -> str:
    """What a reader can ask of the stored samples: units, access points, time span, mean, deviation, mean step."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    step = float(np.abs(np.diff(x)).mean())
    return (
        f"units={len(seen['pts'])};access={len(seen['random_access'])};packets={seen['packets']};"
        f"pts={seen['pts'][0]}-{seen['pts'][-1]};mean={x.mean():.4f};std={x.std():.4f};step={step:.4f}"
    )


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, pts array<long>, random_access array<long>"
)
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def _store(batches):
    for batch in common.parts(batches, 500):
        texts = batch.column(1).to_pylist()
        media = [mux(padded(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _row(doc_id, n: int, media: bytes | None) -> tuple:
    """The digest of one stream; a damaged one has none, and its feature says why."""
    try:
        if media is None:
            raise BrokenStream("no stream")
        payload, seen = demux(media)
        said = features(payload, seen)
    except (BrokenStream, IndexError, struct.error) as e:
        return (doc_id, n, None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), f"damaged: {e}", None, None)
    return (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), said, seen["pts"], seen["random_access"])


def _digest(batches):
    names = [f.strip().split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in common.parts(batches, 500):
        rows = [_row(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a transport stream. A map over rows; nothing is shuffled."""
    return common.id_and_bytes(docs, id_col, text_col).mapInArrow(_store, MEDIA_SCHEMA)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The streams, written to the shared folder and read from there."""
    return common.checkpointed(store(docs, id_col, text_col), "zstd")


def read(media: DataFrame) -> DataFrame:
    """Digest columns of stored streams, computed from the bytes read back. A damaged or missing stream gives a row without
    payload, and its feature says what is wrong."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, SCHEMA)
