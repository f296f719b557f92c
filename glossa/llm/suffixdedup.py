"""Exact substring removal by suffix arrays: every byte covered by a LENGTH-byte string that also starts earlier goes.

Equal strings have to meet although no machine can hold all suffixes. Each LENGTH-byte window is keyed by the smallest
hash of its GRAM-byte grams, which depends on the window's bytes alone, so equal windows share a key; consecutive windows
that take their key from one gram form a run, and a run's bytes are a short string. Keys that occur once in the whole corpus can hold no
repeated window, and those runs are never moved. All other strings, with every place where they stand, are dealt to shards
by key. In a shard, strings that are equal as a whole are told first, by a digest and then their bytes, and stand once for
all their places: all but the earliest place goes. What different strings share is told by suffix arrays. A shard takes its
distinct strings in parts of whole keys, and

* builds the suffix array of a part by Larsson-Sadakane refinement (prefix doubling, sorting only groups that are
  still tied, vectorised in numpy) as far as windows reach,
* takes common prefixes by Kasai's algorithm, in many lanes side by side,
* reads groups of equal windows off the common prefixes and removes all but the earliest window.

A chunk sends one of its equal strings. Keys with more than SPLIT strings are split over several shards by the strings'
content; what is left in the shards is then cut into merging tasks by longer grams, and the sorted lists of distinct windows
are merged two by two by binary search, so the earliest window of all shards stays.

Decisions are judged on the input. All exchanges carry keys, candidate strings or places; the text itself is exchanged
once, by chunk of doc_id.

Defined results: a null text is an empty one (nothing to remove); strings never cross documents; rows with equal doc_id
count in the order of their texts; rows without doc_id come after all others, in the order of a hash of their texts; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import common

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: A key with more occurrences is split over shards, one for each so many.
SPLIT = 256
#: Bytes of strings that one suffix array takes, but for a key that has more.
PART = 1 << 20
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
#: Windows of split keys meet by grams of so many bytes.
LONG = 92
#: Bytes of input that are packed by chunk at once.
HELD = 32 << 20
LAST = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    tool, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        data = np.ascontiguousarray(a)
        kind = data.dtype.str.encode().ljust(4)
        planes = data.view(np.uint8).reshape(-1, data.dtype.itemsize).T if data.dtype.itemsize > 1 and len(data) else data
        stored = tool.compress(np.ascontiguousarray(planes).tobytes())
        out.append(struct.pack("<4sII", kind, len(data), len(stored)) + stored)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    tool, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(data):
        kind, n, size = struct.unpack("<4sII", data[at : at + 12])
        kind = np.dtype(kind.decode().strip())
        flat = np.frombuffer(tool.decompress(data[at + 12 : at + 12 + size], max_output_size=max(1, n * kind.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).ravel() if kind.itemsize > 1 and n else flat.view(kind))
        at += 12 + size
    return out


def window_keys(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the window starting at each byte (LENGTH - 1 fewer than bytes), and whether its first gram has the key."""
    h, power, size = text.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    gram, size = h, 1
    while 2 * size <= WINDOW:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    h = np.minimum(h[: len(h) - (WINDOW - size)], h[WINDOW - size :]) if WINDOW > size else h
    return h, gram[: len(h)] == h


def runs(texts: list[bytes]):
    """(document, start, windows, key) of every run, as arrays, in slices of documents."""
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (size == 0 or size + len(texts[k]) <= SLICE):
            size += len(texts[k])
            k += 1
        sizes = np.array([len(t) for t in texts[first:k]])
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(texts[first:k]), np.uint8)
        if len(flat) < LENGTH:
            continue
        key, leads = window_keys(flat)
        doc = np.searchsorted(ends, np.arange(len(key)), side="right")
        # A run ends where the key changes or the gram that gave it leaves the window; so equal windows are never in one
        # run, periodic text or not, and a run has at most WINDOW windows.
        begin = np.ones(len(key), bool)
        begin[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | leads[:-1]
        begin = np.flatnonzero(begin)
        stop = np.minimum(np.append(begin[1:], len(key)), ends[doc[begin]] - LENGTH + 1)  # not into the next document
        real = stop > begin
        s, n = begin[real], (stop - begin)[real]
        d = doc[s]
        if len(s):
            yield first + d, s - (ends[d] - sizes[d]), n, key[s]


def _chunked(batches):
    """Rows packed by chunk, so much input at a time; a packed table takes far less of an exchange than its rows."""
    held, size = [], 0

    def packed():
        table = pa.Table.from_batches(held).combine_chunks()
        rest, tool = table.drop_columns(["chunk"]), zstandard.ZstdCompressor(level=1)
        chunks, data = [], []
        for chunk, part in _split(table.column("chunk").to_numpy()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_table(rest.take(pa.array(part)))
            chunks.append(chunk)
            data.append(tool.compress(sink.getvalue()))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], ["chunk", "data"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > HELD:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _rows(table: pa.Table) -> pa.Table:
    """The rows that were packed."""
    tool = zstandard.ZstdDecompressor()
    return pa.concat_tables(pa.ipc.open_stream(tool.decompress(d)).read_all() for d in table.column("data").to_pylist())


class Chunk:
    """The rows of a chunk in their defined order. tie orders rows without id."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("__id").to_pylist(), [t or b"" for t in table.column("__text").to_pylist()]
        tie = [xxhash.xxh64_intdigest(t) >> 1 if i is None else 0 for i, t in zip(ids, texts, strict=True)]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, tie[k], texts[k]))
        self.order, self.texts = order, [texts[k] for k in order]
        self.ids = np.array([LAST if ids[k] is None else ids[k] for k in order], np.int64)
        self.tie = np.array([tie[k] for k in order], np.int64)


def _blobs(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.binary() if n == "data" else pa.int32() for n in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _split(where: np.ndarray):
    """(value, positions) of each distinct value."""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    values, first = np.unique(where[order], return_index=True)
    for v, part in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        yield v, part


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.uint32)


def _keys(buckets: int):
    """What a chunk says of its keys: per bucket the distinct short keys and how often they occur."""

    def run(key, table):
        chunk = key[0].as_py()
        found = [k for _, _, _, k in runs(Chunk(_rows(table)).texts)]
        rows = []
        if found:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            for b, part in _split(_bucket(keys, buckets)):
                rows.append((b, chunk, _pack(_short(keys[part]), counts[part].astype(np.uint32))))
        return _blobs(rows, ["bucket", "chunk", "data"])

    return run


def _repeated(key, table):
    """Tells each chunk which of its keys occur more than once in the corpus, and how often."""
    bucket = key[0].as_py()
    chunks = table.column("chunk").to_pylist()
    parts = [_unpack(d) for d in table.column("data").to_pylist()]
    short, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    own, inverse = np.unique(short, return_inverse=True)
    total = np.bincount(inverse, weights=count)[inverse].astype(np.int64)
    rows, at = [], 0
    for chunk, (s, _) in zip(chunks, parts, strict=True):
        t = total[at : at + len(s)]
        if (t > 1).any():
            rows.append((chunk, bucket, _pack(s[t > 1], np.minimum(t[t > 1], 1 << 31).astype(np.uint32))))
        at += len(s)
    return _blobs(rows, ["chunk", "bucket", "data"])


def _fresh(order: np.ndarray, key: np.ndarray, digest: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which strings differ from the one before them in an order by key and digest; strings of one digest are compared."""
    fresh = np.ones(len(order), bool)
    near = (key[order[1:]] == key[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
    for k in np.flatnonzero(near).tolist():
        fresh[k + 1] = strings[order[k + 1]] != strings[order[k]]
    return fresh


def _strings(buckets: int, shards: int):
    """The different strings of a chunk's runs whose key is repeated, with their first places, per shard. Rows of a negative
    chunk say what the chunk itself removes: later places of equal strings."""

    def run(key, left, right):
        names = ["shard", "chunk", "data"]
        if not left.num_rows or not right.num_rows:
            return _blobs([], names)
        chunk, own = key[0].as_py(), Chunk(_rows(left))
        marks = [(b, *_unpack(d)) for b, d in zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True)]
        known = np.concatenate([(np.uint64(b) << np.uint64(32)) | s.astype(np.uint64) for b, s, _ in marks])
        often = np.concatenate([c for _, _, c in marks])
        order = np.argsort(known)
        known, often = known[order], often[order]
        held = []
        for doc, start, count, keys in runs(own.texts):
            name = (_bucket(keys, buckets).astype(np.uint64) << np.uint64(32)) | _short(keys).astype(np.uint64)
            at = np.minimum(np.searchsorted(known, name), len(known) - 1)
            hit = np.flatnonzero(known[at] == name)
            held.append((keys[hit], often[at[hit]].astype(np.int64), doc[hit], start[hit], count[hit]))
        if not held:
            return _blobs([], names)
        h, o, d, s, n = (np.concatenate([x[k] for x in held]) for k in range(5))
        # Of strings that are equal as a whole the chunk's first stands for all; the others go, wherever it came from.
        text = [own.texts[i][j : j + k] for i, j, k in zip(d.tolist(), s.tolist(), (n + LENGTH - 1).tolist(), strict=True)]
        digest = np.fromiter(map(xxhash.xxh64_intdigest, text), np.uint64, len(text))
        order = np.lexsort((s, d, digest, h))
        fresh = _fresh(order, h, digest, text)
        later, order = order[~fresh], order[fresh]
        rows = [(chunk % shards, -1 - c, x) for _, c, x in _spans(np.full(len(later), chunk), d[later], s[later], n[later])]
        h, o, d, s, n, digest = (x[order] for x in (h, o, d, s, n, digest))
        ways = np.maximum(-(-o // SPLIT), 1)
        # Dealt by content, so that equal strings of all chunks meet in one shard.
        salt = (digest % ways.astype(np.uint64)).astype(np.int64)
        with np.errstate(over="ignore"):
            shard = (((h ^ salt.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(33)) % np.uint64(shards)
        for v, p in _split(shard.astype(np.int64)):
            # Equal strings side by side compress well.
            p = p[np.lexsort((s[p], d[p], salt[p], h[p]))]
            flat = b"".join([own.texts[i][j : j + k] for i, j, k in zip(d[p].tolist(), s[p].tolist(), (n[p] + LENGTH - 1).tolist(), strict=True)])
            rows.append((v, chunk, _pack(h[p], salt[p].astype(np.uint32), (ways[p] > 1).astype(np.uint8), own.ids[d[p]], own.tie[d[p]], d[p].astype(np.uint32), s[p].astype(np.uint32), n[p].astype(np.uint8), np.frombuffer(flat, np.uint8))))
        return _blobs(rows, names)

    return run


def suffix_array(text: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the bytes and the rank of every suffix, by Larsson-Sadakane refinement: groups of suffixes
    tied at a depth are sorted by the rank of the suffix that many bytes on, and only groups still tied are sorted again.
    The bytes may be several strings (ends: for each byte the end of its own), each closed by a sign of its own that is
    lower than any byte, those of earlier strings lower than later ones'."""
    n, depth = len(text), 7
    kind = np.int32 if n < 1 << 30 else np.int64
    at = np.arange(n, dtype=kind)
    ends = np.full(n, n, kind) if ends is None else ends.astype(kind)
    left = ends - at
    string = np.zeros(n, kind)
    np.cumsum(ends[1:] != ends[:-1], out=string[1:])
    strings = int(string[-1]) + 1 if n else 0
    key = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        key[:-width] = key[:-width] << np.uint64(8 * width) | key[width:]
    size = np.minimum(left, depth).astype(np.uint64)
    key = key[:n] >> np.uint64(8 * (8 - depth)) & ~np.uint64(0) << np.uint64(8) * (np.uint64(depth) - size)
    key = key << np.uint64(8) | size
    order = np.argsort(key).astype(kind)
    key = key[order]
    lead = np.ones(n, bool)
    lead[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(lead, at, 0)).astype(kind)
    rank = np.zeros(n, kind)
    rank[order] = group
    bits = max(1, int(n - 1).bit_length()) if n else 1
    wide = int(n + strings).bit_length()
    while True:
        tied = ~lead
        tied[:-1] |= ~lead[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, rank
        own, first = order[slots], group[slots]
        second = rank[np.minimum(own + kind(depth), n - 1)] + kind(strings)
        over = np.flatnonzero(left[own] <= depth)
        second[over] = string[own[over]]
        if 2 * bits + wide <= 64:  # one sort of group, second key and place in one number
            packed = (first.astype(np.uint64) << np.uint64(wide) | second.astype(np.uint64)) << np.uint64(bits) | own.astype(np.uint64)
            packed.sort()
            own = (packed & np.uint64((1 << bits) - 1)).astype(kind)
            packed >>= np.uint64(bits)
        else:
            packed = first.astype(np.int64) * (n + strings + 1) + second
            sub = np.argsort(packed)
            own, packed = own[sub], packed[sub]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = packed[1:] != packed[:-1]
        order[slots], lead[slots] = own, fresh
        first = np.maximum.accumulate(np.where(fresh, slots, 0)).astype(kind)
        group[slots], rank[own] = first, first
        depth *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, ends: np.ndarray | None = None, most: int = 128, lane: int = 256) -> np.ndarray:
    """Kasai's common prefixes of each suffix with the one before it in the array, up to most bytes. The text is walked in
    lanes side by side; a lane begins without a known prefix and then loses at most one byte from place to place."""
    n = len(text)
    kind = np.int32 if n < 1 << 30 else np.int64
    before = np.full(n, -1, kind)
    before[order[1:]] = order[:-1]
    ends = np.full(n, n, kind) if ends is None else ends.astype(kind)
    # How far a common prefix can reach: to the end of either string.
    reach = np.where(before >= 0, np.minimum(np.minimum(ends - np.arange(n, dtype=kind), ends[before] - before), most), 0).astype(kind)
    out = np.zeros(n, kind)
    at = np.arange(0, n, lane, dtype=kind)
    stop = np.minimum(at + lane, n).astype(kind)
    have = np.zeros(len(at), kind)
    while len(at):
        far = reach[at]
        i, j = np.minimum(at + have, n - 1), np.minimum(before[at] + have, n - 1)
        more = (have < far) & (text[i] == text[j])
        done = ~more
        out[at[done]] = have[done]
        have = np.where(more, have + 1, np.maximum(have - 1, 0)).astype(kind)
        at = at + done
        live = at < stop
        if not live.all():
            at, stop, have = at[live], stop[live], have[live]
    return out


def _equal(flat: np.ndarray, begin: np.ndarray, count: np.ndarray):
    """Windows of strings (of count windows each, from begin on): their strings, offsets and positions, the number of the
    group of equal windows that each is in."""
    total = int(count.sum())
    owner = np.repeat(np.arange(len(count)), count)
    offset = np.arange(total) - (np.cumsum(count) - count)[owner]
    position = begin[owner] + offset
    ends = np.repeat(begin + count + LENGTH - 1, count + LENGTH - 1)
    order, _ = suffix_array(flat, ends)
    group = np.zeros(len(flat), np.int64)
    group[order] = np.cumsum(common_prefixes(flat, order, ends)[order] < LENGTH)
    return owner, offset, position, group[position]


def _spans(chunk: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray):
    """Rows (route, chunk, data) that tell chunks what to remove."""
    for c, part in _split(chunk):
        yield c, c, _pack(row[part].astype(np.uint32), start[part].astype(np.uint32), count[part].astype(np.uint32))


def _route(text: np.ndarray) -> np.ndarray:
    """A hash of each window that neighbouring windows mostly share: the smallest of its LONG-byte grams'."""
    h, size = text.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        while size < LONG:
            step = min(size, LONG - size)
            h = (h[:-step] ^ h[:-step] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + h[step:]
            size += step
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.lib.stride_tricks.sliding_window_view(h, LENGTH - LONG + 1).min(axis=1) >> np.uint64(20)


def _shard(routes: int):
    def run(key, table):
        chunks, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
        rows = [((-1 - c) % routes, -1 - c, d) for c, d in zip(chunks, data, strict=True) if c < 0]
        parts = [_unpack(d) for c, d in zip(chunks, data, strict=True) if c >= 0]
        chunks = [c for c in chunks if c >= 0]
        if not parts:
            return _blobs(rows, ["route", "chunk", "data"])
        chunk = np.repeat(np.array(chunks, np.int64), [len(p[0]) for p in parts])
        h, salt, hot, ids, tie, row, start, count = (np.concatenate([p[k] for p in parts]) for k in range(8))
        row, start, count = row.astype(np.int64), start.astype(np.int64), count.astype(np.int64)
        flat = np.concatenate([p[8] for p in parts])
        del parts
        size = count + LENGTH - 1
        begin = np.cumsum(size) - size
        # Windows of one document that belong to several strings still compare by document and start.
        by = np.lexsort((row, chunk, tie, ids))
        new = np.ones(len(by), np.int64)
        new[1:] = (row[by[1:]] != row[by[:-1]]) | (chunk[by[1:]] != chunk[by[:-1]]) | (ids[by[1:]] != ids[by[:-1]])
        place = np.zeros(len(by), np.int64)
        place[by] = np.cumsum(new) << 32
        place += start
        # Strings by key, equal ones side by side.
        buffer = flat.tobytes()
        strings = [buffer[i:j] for i, j in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
        digest = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        order = np.lexsort((digest, salt, h))
        edge = np.ones(len(order), bool)
        edge[1:] = (h[order[1:]] != h[order[:-1]]) | (salt[order[1:]] != salt[order[:-1]])
        fresh = edge | _fresh(order, h, digest, strings)
        del strings, buffer
        # Parts of whole keys. A string alone with its key holds no repeated window, unless other shards have the key too.
        first = np.flatnonzero(edge)
        reach = np.concatenate(([0], np.cumsum(np.where(fresh, size[order], 0))))
        alone = (np.diff(np.append(first, len(order))) == 1) & (hot[order[first]] == 0)
        gone, cut = [], 0
        while cut < len(first):
            end = max(cut + 1, int(np.searchsorted(reach[first], reach[first[cut]] + PART, side="right")) - 1)
            part = slice(first[cut], first[end] if end < len(first) else len(order))
            keep = ~np.repeat(alone[cut:end], np.diff(np.append(first[cut:end], part.stop)))
            own, new = order[part][keep], fresh[part][keep]
            cut = end
            if not len(own):
                continue
            kind, lead = np.cumsum(new) - 1, own[new]
            n = size[lead]
            text = flat[np.repeat(begin[lead] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            owner, offset, position, group = _equal(text, np.cumsum(n) - n, count[lead])
            # The earliest place of each group, over all places of its strings.
            soonest = np.minimum.reduceat(place[own], np.flatnonzero(new))
            here = soonest[owner] + offset
            by = np.lexsort((here, group))
            earliest = np.zeros(int(group.max()) + 1, np.int64)
            head = by[np.append(True, group[by[1:]] != group[by[:-1]])]
            earliest[group[head]] = here[head]
            # All windows of all places.
            m = count[own]
            copy = np.repeat(np.arange(len(own)), m)
            step = np.arange(len(copy)) - (np.cumsum(m) - m)[copy]
            window = (np.cumsum(count[lead]) - count[lead])[kind][copy] + step
            later = place[own][copy] + step != earliest[group[window]]
            at = np.flatnonzero(later)
            if len(at):
                head = np.ones(len(at), bool)
                head[1:] = (np.diff(at) != 1) | (copy[at[1:]] != copy[at[:-1]])
                at, length = at[head], np.diff(np.append(np.flatnonzero(head), len(at)))
                w = own[copy[at]]
                gone.append((chunk[w], row[w], start[w] + step[at], length))
            left = np.flatnonzero(~later & (hot[own][copy] > 0))
            if len(left):  # to be merged with other shards' windows, by content; what goes one way is one string
                at = position[window[left]]
                name = _route(text)[at]
                head = np.ones(len(left), bool)
                head[1:] = (np.diff(left) != 1) | (copy[left[1:]] != copy[left[:-1]]) | (name[1:] != name[:-1])
                length = np.diff(np.append(np.flatnonzero(head), len(left)))
                left, at, name = left[head], at[head], name[head]
                w = own[copy[left]]
                first_at = chunk[w], ids[w], tie[w], row[w], start[w] + step[left]
                for route, p in _split((name % np.uint64(routes)).astype(np.int64)):
                    p = p[np.argsort(name[p], kind="stable")]
                    n = length[p] + LENGTH - 1
                    rows.append((route, -1, _pack(*(x[p] for x in first_at), length[p].astype(np.uint8), text[np.repeat(at[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())])))
        if gone:
            c, r, s, n = (np.concatenate([g[k] for g in gone]) for k in range(4))
            rows += [(a % routes, b, d) for a, b, d in _spans(c, r, s, n)]
        return _blobs([(int(a), int(b), d) for a, b, d in rows], ["route", "chunk", "data"])

    return run


class Sorted:
    """A sorted list of distinct windows, each with its earliest known place (chunk, id, tie, row, start)."""

    def __init__(self, names: np.ndarray, place: list[np.ndarray]):
        self.names, self.place = names, place

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows stand or would be put, and which are there."""
        at = np.searchsorted(self.names, names)
        return at, self.names[np.minimum(at, len(self.names) - 1)] == names

    def merged(self, other: Sorted) -> Sorted:
        """Both lists' windows, by binary search of the other's in this one."""
        at, same = self.find(other.names)
        mine, theirs = at[same], np.flatnonzero(same)
        sooner, tied = np.zeros(len(mine), bool), np.ones(len(mine), bool)
        for c in (1, 2, 0, 3, 4):  # id, tie, chunk, row, start
            a, b = self.place[c][mine], other.place[c][theirs]
            sooner |= tied & (b < a)
            tied &= a == b
        place = []
        for a, b in zip(self.place, other.place, strict=True):
            best = a.copy()
            best[mine[sooner]] = b[theirs[sooner]]
            place.append(np.insert(best, at[~same], b[~same]))
        return Sorted(np.insert(self.names, at[~same], other.names[~same]), place)


def _merge(key, table):
    """Merges sorted lists of windows two by two; all but the earliest of equal ones go. Other rows pass."""
    rows, lists = [], []
    for chunk, data in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist(), strict=True):
        if chunk >= 0:
            rows.append((chunk, data))
            continue
        *place, count, text = _unpack(data)
        count = count.astype(np.int64)
        # The windows of each string; a closing byte keeps zero bytes at the end of a window significant.
        owner = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        at = (np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1))[owner] + step
        names = np.concatenate((text[at[:, None] + np.arange(LENGTH)[None, :]], np.ones((len(at), 1), np.uint8)), axis=1).view(f"S{LENGTH + 1}").ravel()
        order = np.argsort(names)
        place = [p.astype(np.int64)[owner] for p in place]
        place[4] += step
        lists.append(Sorted(names[order], [p[order] for p in place]))
    if lists:
        level = lists
        while len(level) > 1:
            level = sorted(level, key=lambda x: len(x.names))
            level = [b.merged(a) for a, b in zip(level[::2], level[1::2], strict=False)] + level[len(level) - len(level) % 2 :]
        for x in lists:
            at, _ = level[0].find(x.names)
            out = np.zeros(len(at), bool)
            for a, b in zip(x.place, level[0].place, strict=True):
                out |= a != b[at]
            rows += [(c, d) for _, c, d in _spans(*(x.place[c][out] for c in (0, 3, 4)), np.ones(int(out.sum()), np.int64))]
    return _blobs(rows, ["chunk", "data"])


def removed(texts: list[bytes], right: pa.Table) -> list[np.ndarray]:
    """For each text of a chunk the places where removal starts and ends, alternating."""
    parts = [_unpack(d) for d in right.column("data").to_pylist()]
    if not parts:
        return [np.zeros(0, np.int64)] * len(texts)
    row, start, count = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
    out = []
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + count + LENGTH - 1)[order]
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        a, b = start[at[k] : at[k + 1]], end[at[k] : at[k + 1]]
        if not len(a):
            out.append(np.zeros(0, np.int64))
            continue
        reach = np.maximum.accumulate(b)
        new = np.ones(len(a), bool)
        new[1:] = a[1:] > reach[:-1]
        first = np.flatnonzero(new)
        out.append(np.stack((a[first], reach[np.append(first[1:], len(a)) - 1]), axis=1).ravel())
    return out


def keep(text: bytes, spans: np.ndarray) -> bytes:
    bounds = [0, *spans.tolist(), len(text)]
    return b"".join([text[bounds[k] : bounds[k + 1]] for k in range(0, len(bounds), 2)])


def _applied(docs: DataFrame, id_col: str, text_col: str, rest: list[str], finish, schema):
    """The whole plan; finish(chunk's table, Chunk, spans) makes the result of a chunk."""
    n = common.partitions_for(docs)
    buckets = common.buckets_for(n)
    frame = docs.select(
        common.chunk_of(id_col, text_col, n),
        F.col(id_col).cast("long").alias("__id"),
        F.col(text_col).cast("string").cast("binary").alias("__text"),
        *(F.col(c).alias(f"__c{k}") for k, c in enumerate(rest)),
    )
    chunks = frame.mapInArrow(_chunked, "chunk int, data binary").repartition(n, "chunk").groupBy("chunk")
    keys = chunks.applyInArrow(common.lean(_keys(buckets)), "bucket int, chunk int, data binary").repartition(buckets, "bucket")
    marks = keys.groupBy("bucket").applyInArrow(common.lean(_repeated), "chunk int, bucket int, data binary").repartition(n, "chunk")
    strings = chunks.cogroup(marks.groupBy("chunk")).applyInArrow(common.lean(_strings(buckets, 2 * buckets)), "shard int, chunk int, data binary").repartition(2 * buckets, "shard")
    routed = strings.groupBy("shard").applyInArrow(common.lean(_shard(buckets)), "route int, chunk int, data binary").repartition(buckets, "route")
    spans = routed.groupBy("route").applyInArrow(common.lean(_merge), "chunk int, data binary").repartition(n, "chunk")

    def end(key, left, right):
        table = _rows(left)
        own = Chunk(table)
        return finish(table, own, removed(own.texts, right))

    return chunks.cogroup(spans.groupBy("chunk")).applyInArrow(common.lean(end), schema)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _digest(table: pa.Table, own: Chunk, spans: list[np.ndarray]) -> pa.Table:
    ids = table.column("__id").take(pa.array(own.order, pa.int64()))
    size = [int(x[1::2].sum() - x[0::2].sum()) for x in spans]
    return pa.table(
        [
            ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array([len(t) for t in own.texts], pa.int64()), pa.array(size, pa.int64()),
            pa.array([len(x) // 2 for x in spans], pa.int64()), pa.array([hashlib.sha256(keep(t, x)).hexdigest() for t, x in zip(own.texts, spans, strict=True)]),
            pa.array([x.tolist() for x in spans], pa.list_(pa.int64())),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: bytes, removed bytes, removed spans (their bounds too) and the hash of what is left."""
    return _applied(docs, id_col, text_col, [], _digest, SCHEMA)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The input's rows and columns with the text that is left; a character cut in two by a removal goes with it. A
    column of character counts follows the text. Null texts stay null."""
    schema, names = docs.schema, docs.columns

    def finish(table: pa.Table, own: Chunk, spans: list[np.ndarray]) -> pa.Table:
        at = pa.array(own.order, pa.int64())
        null = table.column("__text").take(at).is_null().to_pylist()
        text = [None if x else keep(t, s).decode("utf-8", "ignore") for t, s, x in zip(own.texts, spans, null, strict=True)]
        columns = []
        for k, c in enumerate(names):
            if c == text_col:
                columns.append(pa.array(text, pa.string()))
            elif c == chars_col and isinstance(schema[c].dataType, T.IntegralType):
                columns.append(pa.array([None if t is None else len(t) for t in text]).cast(table.column(f"__c{k}").type))
            else:
                columns.append(table.column(f"__c{k}").take(at).combine_chunks())
        return pa.table(columns, names)

    return _applied(docs, id_col, text_col, names, finish, schema)
