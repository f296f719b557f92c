"""Near-duplicate passages by compact windows.

A document is its sequence of SHINGLE-word shingles. Under one hash function, all subsequences of at least SPAN shingles
with the same smallest hash form a compact window (l, c, r): c holds the minimum of every subsequence from between l and c
to between c and r. Those are the nodes of the Cartesian tree over the hashes whose subtree is at least SPAN long, and
equally the runs of a sliding minimum over SPAN shingles, which is how numpy finds them. The intervals of every two of
FUNCTIONS functions are joined: where they meet, the pair of minima is one signature of all passages between their bounds,
if the two stand APART shingles or more from each other (or the text repeats itself at one of them). Two passages that agree in 80 % of their shingles share one of the
fifteen with a probability of 0.95 and more, while a common line can't hold both minima.

Windows whose signature occurs once in the corpus never leave their chunk of documents. The others meet by signature, first
inside the chunk, then over all chunks: those that hold an equal SPAN-long passage (told by hashes of every CHOICE-th of
their passages, counted from the centre) are joined without a comparison, and one window of a chunk's joined ones goes on. That
gives components of documents; then windows of documents of different components that still share a signature are compared,
in blocks over tasks. Two windows are linked if around their common shingle

* they hold SPAN-long passages that share 80 % (Jaccard of the sets of shingles, in whatever order), or
* they hold longer passages of any two lengths that do, shingles in one order (insertions and deletions); for this, REACH
  shingles to either side are looked at. Of a longer pair of passages that share 80 %, a part that reaches so far does too,
  because shared and unshared shingles add up over parts.

In a large group pairs that share too few shingles are left out by their rarest ones; none are left out otherwise.

Defined results: one row per document with a link; null and short texts (under SPAN shingles) have none; repetition inside
a document is no link; rows with equal doc_id are documents of their own and count as one in the result; rows without
doc_id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.llm.components import components
from glossa.llm.simhash import Stars
from glossa.llm.suffixdedup import LAST, _blobs, _bucket, _pack, _repeated, _short, _split, _unpack

SHINGLE, SPAN, FUNCTIONS, APART, REACH = 5, 46, 6, 12, 80
#: Of so many neighbouring passages of a window one is compared for equality, by how far before the centre it starts.
CHOICE = 3
#: Shared shingles that make 0.8 of the union of two SPAN-long passages without repetition.
ENOUGH = -(-8 * 2 * SPAN // 18)
#: Classes of a group that one task compares with as many others, and of a group that are all compared without looking at
#: rare shingles.
BLOCK, FEW = 512, 64
#: Windows of the same two documents on one diagonal whose centres are that near are compared once, over NEAR shingles.
STEP, NEAR = 16, SPAN - 1 + 16
#: Windows that a component shares with others and that one task takes.
TASK = 32_768
#: Bytes hashed at once; longer texts are a slice of their own.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


#: An odd factor for each function.
_ODD = [(_BASE * (2 * k + 1) ^ (k * 0x632BE59BD9B4E019)) & (2**64 - 1) | 1 for k in range(16)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((k + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


#: Numbers below _TIED are mixed and unmixed with these odd factors.
_TIED, _FACTORS = 1 << 31, (0x2C1B3C6D, 0x297A2D39)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _FACTORS[0] & (_TIED - 1)
    return (x ^ x >> 16) * _FACTORS[1] & (_TIED - 1)


def _unmixed(x: np.ndarray) -> np.ndarray:
    x = x * pow(_FACTORS[1], -1, _TIED) & (_TIED - 1)
    return (x ^ x >> 16) * pow(_FACTORS[0], -1, _TIED) & (_TIED - 1)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The shingle hashes of each text; words are runs without ASCII blanks, A-Z lower-cased."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)])))
        word = _mix((sums[end] - sums[start]) * inverse[start], 90)
        h = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x100000001B3 * 2 + 1) + word[k : len(word) - SHINGLE + 1 + k] if len(h) else h
        h = _mix(h, 91)
    stops = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    first = np.concatenate(([0], stops[:-1]))
    return [h[a : max(a, b - SHINGLE + 1)] for a, b in zip(first.tolist(), stops.tolist(), strict=True)]


def _minima(v: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The smallest of every span in a row."""
    low, width = v, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(low) - (span - width)], low[span - width :]) if width < span else low


def windows(x: list[np.ndarray]):
    """(document, centre, signature, steps, place, content) of every joint window of several documents, two functions by
    two: the centre holds the first function's minimum; steps say how far before the centre the first and the last of its
    SPAN-long passages start; content has a hash of the passage that starts at each place of all documents, and the centre
    is at place there."""
    size = np.array([len(s) for s in x])
    ends = np.cumsum(size)
    flat = np.concatenate(x) if len(x) else np.zeros(0, np.uint64)
    n = len(flat) - SPAN + 1
    if n <= 0:
        return
    doc = np.searchsorted(ends, np.arange(n), side="right")
    border = np.ones(n, bool)
    border[1:] = doc[1:] != doc[:-1]
    power, inverse = _powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat * power[: len(flat)])))
        content = _short(_mix((sums[SPAN:] - sums[:-SPAN]) * inverse[:n], 92))
    own = np.arange(len(flat)) - np.repeat(ends - size, size)
    # Where text repeats itself within APART shingles, minima can't stand further from each other. Of equal ones there that of
    # a mixed number of its place is taken, which stays for many windows; the first would be another one in each.
    again = np.zeros(len(flat), bool)
    for k in range(1, APART):
        same = np.flatnonzero((flat[:-k] == flat[k:]) & (own[k:] >= k))
        again[same] = again[same + k] = True
    minima, places = [], np.where(again, _mixed(own) | _TIED, own).astype(np.uint64)
    for f in range(FUNCTIONS):
        with np.errstate(over="ignore"):
            # Hashes with their places, so that the smallest is the first of equal ones elsewhere.
            low = _minima(flat * np.uint64(_ODD[f]) & np.uint64(0xFFFFFFFF00000000) | places)
        # A run ends where the minimum changes or its place leaves the window; the centre is that place.
        begin = border.copy()
        begin[1:] |= low[1:] != low[:-1]
        at = (low[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.where(at >= _TIED, _unmixed(at & (_TIED - 1)), at) + (ends - size)[doc[begin]]
        # Windows over the end of a document have no place; they are left out below.
        minima.append((begin, np.cumsum(begin, dtype=np.int32) - 1, np.minimum(at, len(flat) - 1)))
    last = np.minimum(ends - SPAN + 1, n)
    for f in range(FUNCTIONS):
        for g in range(f):
            begin = np.flatnonzero(minima[f][0] | minima[g][0])
            stop = np.minimum(np.append(begin[1:], n), last[doc[begin]])
            centre, other = (m[2][m[1][begin]] for m in (minima[f], minima[g]))
            real = (stop > begin) & ((np.abs(centre - other) >= APART) | again[centre] | again[other])
            s, e, centre, other = begin[real], stop[real], centre[real], other[real]
            steps = ((centre - s) << 8 | (centre - e + 1)).astype(np.uint16)
            with np.errstate(over="ignore"):
                sig = _mix(flat[centre] + flat[other] * np.uint64(_BASE), 50 + f * FUNCTIONS + g)
            yield doc[s], centre - (ends[doc[s]] - size[doc[s]]), sig, steps, centre, content


def slices(texts: list[bytes]):
    """(first document, shingle hashes of the documents) in slices of bounded size."""
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (size == 0 or size + len(texts[k]) <= SLICE):
            size += len(texts[k])
            k += 1
        yield first, shingles(texts[first:k])


class Chunk:
    """The rows of a chunk in a defined order; rows without id come as empty texts."""

    def __init__(self, table):
        ids, texts = table.column("__id").to_pylist(), table.column("__text").to_pylist()
        texts = [b"" if t is None or i is None else t for i, t in zip(ids, texts, strict=True)]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]

    def windows(self):
        for first, x in slices(self.texts):
            for doc, *rest in windows(x):
                yield first + doc, *rest


def _keys(buckets: int):
    def run(key, table):
        chunk, found, rows = key[0].as_py(), [w[2] for w in Chunk(table).windows()], []
        if found:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            for b, part in _split(_bucket(keys, buckets)):
                rows.append((b, chunk, _pack(_short(keys[part]), counts[part].astype(np.uint32))))
        return _blobs(rows, ["bucket", "chunk", "data"])

    return run


def _ragged(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first to its end."""
    n = end - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _joined(sig: np.ndarray, count: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """The first window of each window's component: windows of one signature that share a choice are joined. sig must be
    ascending."""
    owner = np.repeat(np.arange(len(sig)), count)
    group = np.cumsum(np.append(np.zeros(1, np.int64), sig[1:] != sig[:-1])) if len(sig) else sig
    name = group[owner].astype(np.uint64) << np.uint64(32) | choice.astype(np.uint64)
    order = np.argsort(name)
    name, o = name[order], owner[order]
    same = np.flatnonzero(name[1:] == name[:-1])
    stars = Stars(len(sig))
    stars.add(o[same + 1], o[same])
    return stars.flush()


def _met(buckets: int, spelled: bool):
    """The windows of a chunk whose signature occurs again, per bucket: of joined ones that of the smallest id, with its own
    choices and those that several share; links among them are a row of bucket -1. Or all windows (spelled)."""

    def run(key, left, right):
        names = ["bucket", "chunk", "data"]
        if not left.num_rows or not right.num_rows:
            return _blobs([], names)
        chunk = key[0].as_py()
        known = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | _unpack(d)[0].astype(np.uint64) for b, d in zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True)]))
        held, own = [], Chunk(left)
        all_ids = np.array([0 if i is None else i for i in own.ids], np.int64)
        for doc, centre, keys, steps, place, content in own.windows():
            name = (_bucket(keys, buckets).astype(np.uint64) << np.uint64(32)) | _short(keys).astype(np.uint64)
            by = np.argsort(name)  # looked up in order, which is faster
            name = name[by]
            hit = by[known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name]
            if len(hit):
                # Choices: how many CHOICEs before the centre a passage starts, from front to back.
                near, far = -(-(steps[hit] & 255).astype(np.int64) // CHOICE), (steps[hit] >> 8).astype(np.int64) // CHOICE + 1
                count = np.maximum(far - near, 0)
                at = np.repeat(place[hit], count) - CHOICE * _ragged(near, near + count)
                held.append((keys[hit], doc[hit].astype(np.uint32), centre[hit].astype(np.uint32), steps[hit], count, content[at]))
        if not held:
            return _blobs([], names)
        keys, doc, centre, steps, count, choice = (np.concatenate([h[k] for h in held]) for k in range(6))
        ids = all_ids[doc]
        # By signature, then by document, which is by id.
        order = np.lexsort((doc.astype(np.int64) << 32 | centre, keys))
        first = np.cumsum(count) - count
        choice = choice[_ragged(first[order], (first + count)[order])]
        keys, doc, centre, steps, count, ids = (x[order] for x in (keys, doc, centre, steps, count, ids))
        rows = []
        if not spelled:
            # The first of a component has its smallest id.
            root = _joined(keys, count, choice)
            high = ids.copy()
            np.maximum.at(high, root, ids)
            member = np.flatnonzero(high[root] != ids[root])
            if len(member):
                rows.append((chunk % buckets, -1, _told(ids[member], ids[root[member]], centre[member])))
            owner = np.repeat(np.arange(len(keys)), count)
            kept = root[owner] == owner
            name = root[owner].astype(np.uint64) << np.uint64(32) | choice.astype(np.uint64)
            by = np.argsort(name)
            twice = np.zeros(len(owner), bool)
            twice[by[1:]] = name[by[1:]] == name[by[:-1]]
            name = np.unique(name[kept | twice])
            at = np.flatnonzero(root == np.arange(len(root)))
            count = np.bincount((name >> np.uint64(32)).astype(np.int64), minlength=len(keys))[at]
            choice = name.astype(np.uint32)
            keys, doc, centre, steps, ids = (x[at] for x in (keys, doc, centre, steps, ids))
        first = np.cumsum(count) - count
        for b, p in _split(_bucket(keys, buckets)):
            rows.append((b, chunk, _pack(_short(keys[p]), doc[p], centre[p], steps[p], ids[p], count[p].astype(np.uint32), choice[_ragged(first[p], (first + count)[p])])))
        return _blobs(rows, names)

    return run


def _told(ids: np.ndarray, low: np.ndarray, word: np.ndarray) -> bytes:
    """Links of documents, packed: for each document the smallest id of its component among these links, and its smallest
    word."""
    name, at = np.unique(np.concatenate((ids, low)), return_inverse=True)
    stars = Stars(len(name))
    stars.add(at[: len(ids)], at[len(ids) :])
    root = stars.flush()
    least = np.full(len(name), LAST)
    np.minimum.at(least, at[: len(ids)], np.asarray(word, np.int64))
    k = np.flatnonzero(least < LAST)
    return _pack(name[k], name[root[k]], least[k].astype(np.uint32))


LEFT = "data binary, sig long, chunk int, doc int, centre int, steps int, doc_id long"


def _groups(buckets: int, spelled: bool):
    """Joins the windows of all chunks. Rows with data are links, for each share of the documents (in chunk); the others are
    one window of each joined set, where a signature has several sets and they are not all of one document."""

    def run(key, table):
        bucket, data = key[0].as_py(), table.column("data").to_pylist()
        where = table.column("chunk").to_pylist()
        told = [_unpack(d) for c, d in zip(where, data, strict=True) if c < 0]
        parts = [_unpack(d) for c, d in zip(where, data, strict=True) if c >= 0]
        columns = [np.zeros(0, np.int64)] * 6
        if parts:
            chunk = np.repeat(np.array([c for c in where if c >= 0], np.int64), [len(p[0]) for p in parts])
            sig, doc, centre, steps, ids, count = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(6))
            choice = np.concatenate([p[6] for p in parts])
            order = np.lexsort((chunk << 44 ^ doc << 24 ^ centre, ids, sig))
            first = np.cumsum(count) - count
            choice = choice[_ragged(first[order], (first + count)[order])]
            chunk, sig, doc, centre, steps, ids, count = (x[order] for x in (chunk, sig, doc, centre, steps, ids, count))
            root = np.arange(len(sig))
            if not spelled:
                root = _joined(sig, count, choice)
                high = ids.copy()
                np.maximum.at(high, root, ids)
                k = np.flatnonzero(high[root] != ids[root])
                if len(k):
                    told.append((ids[k], ids[root[k]], centre[k]))
            k = np.flatnonzero(root == np.arange(len(root)))
            edge = np.ones(len(k), bool)
            edge[1:] = sig[k[1:]] != sig[k[:-1]]
            starts = np.flatnonzero(edge)
            several = np.minimum.reduceat(ids[k], starts) != np.maximum.reduceat(ids[k], starts)
            k = k[np.repeat(several, np.diff(np.append(starts, len(k))))]
            columns = [np.int64(bucket) << np.int64(32) | sig[k], *(x[k] for x in (chunk, doc, centre, steps, ids))]
        shares = []
        if told:
            # What is linked in a bucket is told once; what buckets tell of a document meets in its share.
            links = _unpack(_told(*(np.concatenate([t[k] for t in told]) for k in range(3))))
            shares = [(c, _pack(*(x[p] for x in links))) for c, p in _split(_bucket(_mix(links[0].astype(np.uint64), 93), buckets))]
        n, none = len(columns[0]), np.zeros(len(shares), np.int64)
        where = [none, np.array([c for c, _ in shares], np.int64), none, none, none, none]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array([d for _, d in shares] + [None] * n, pa.binary()), *(pa.array(np.concatenate(x), t) for *x, t in zip(where, columns, kinds, strict=True))], ["data", "sig", "chunk", "doc", "centre", "steps", "doc_id"])

    return run


def _sequences(own: Chunk, wanted: set[int]) -> dict[int, np.ndarray]:
    held = {}
    rows = sorted(wanted)
    for first, x in slices([own.texts[r] for r in rows]):
        held.update(zip(rows[first : first + len(x)], x, strict=True))
    return held


def _answers(key, left, right):
    """Adds the short hashes of the shingles around the centre to each window that was asked for, packed per task."""
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["task", "data"])
    own = Chunk(left)
    task, sig, side, doc, centre, steps, ids, part = (right.column(c).to_numpy() for c in ("task", "sig", "side", "doc", "centre", "steps", "doc_id", "part"))
    x = _sequences(own, set(np.unique(doc).tolist()))
    rows = []
    for name, p in _split(task):
        texts = [_short(x[d][max(0, c - REACH) : c + REACH + 1]) for d, c in zip(doc[p].tolist(), centre[p].tolist(), strict=True)]
        length = np.fromiter(map(len, texts), np.uint8, len(texts))
        rows.append((name, _pack(sig[p], side[p].astype(np.uint8), length, np.minimum(centre[p], REACH).astype(np.uint8), (steps[p] >> 8).astype(np.uint8), (steps[p] & 255).astype(np.uint8), part[p], ids[p], centre[p].astype(np.uint32), np.concatenate(texts))))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["task", "data"])


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the SPAN-long passages from each place of a and from each place of b share, for rows of frames in
    which no shingle comes twice."""
    same = np.zeros((len(a), a.shape[1] + 1, b.shape[1] + 1), np.int16)
    same[:, 1:, 1:] = a[:, :, None] == b[:, None, :]
    same = same.cumsum(axis=1, dtype=np.int16).cumsum(axis=2, dtype=np.int16)
    same = same[:, SPAN:] - same[:, :-SPAN]
    return same[:, :, SPAN:] - same[:, :, :-SPAN]


def similar(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, shared) of the SPAN-long passages that share 80 % (Jaccard of the sets), for any text."""
    sets = [[frozenset(x[k : k + SPAN].tolist()) for k in range(len(x) - SPAN + 1)] for x in (a, b)]
    return [(i, j, n) for i, p in enumerate(sets[0]) for j, q in enumerate(sets[1]) if 18 * (n := len(p & q)) >= 8 * (len(p) + len(q))]


def stretch(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """(start, end, start, end, shared) of the longest passages of a and b, at least SPAN long, that share 80 %, as told by
    shingles that both have in one order. Counting nine for each shared shingle and minus four for each shingle of either
    passage, the sum of such a pair isn't negative."""
    values, at = np.unique(b, return_index=True)
    k = np.minimum(np.searchsorted(values, a), len(values) - 1)
    i = np.flatnonzero(values[k] == a)
    _, first = np.unique(a[i], return_index=True)
    i = i[np.sort(first)]
    j = at[k[i]]
    if len(i) < ENOUGH or len(a) < SPAN or len(b) < SPAN:
        return None
    n, i, j = (x.astype(np.int16) for x in (np.arange(len(i)), i, j))  # texts have 2 * REACH + 1 shingles at most
    wide = [np.maximum(p[None, :] - p[:, None] + np.int16(1), np.int16(SPAN)) for p in (i, j)]
    score = 9 * (n[None, :] - n[:, None] + 1) - 4 * wide[0] - 4 * wide[1]
    good = (score >= 0) & (n[None, :] >= n[:, None]) & (j[None, :] >= j[:, None])
    found = np.flatnonzero(good)
    for p, q in zip(*np.unravel_index(found[np.argsort(-wide[0].ravel()[found], kind="stable")[:8]], good.shape), strict=True):
        bounds = []
        for x, text in ((i, a), (j, b)):
            start, end = int(x[p]), int(x[q]) + 1
            if end - start < SPAN:
                end = min(len(text), start + SPAN)
                start = end - SPAN
            bounds += [start, end]
        s, t = set(a[bounds[0] : bounds[1]].tolist()), set(b[bounds[2] : bounds[3]].tolist())
        if 18 * (shared := len(s & t)) >= 8 * (len(s) + len(t)):
            return (*bounds, shared)
    return None


class Classes:
    """The windows of one task with the texts around their centres. part: the component of the window's document."""

    def __init__(self, parts: list[list[np.ndarray]]):
        sig, side, length, left, back, front, part, ids, words, self.flat = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(10))
        order = np.lexsort((words, ids, part, side, sig))
        self.begin = (np.cumsum(length) - length)[order]
        self.sig, self.side, self.length, self.left, self.back, self.front, self.part, self.ids, self.words = (x[order] for x in (sig, side, length, left, back, front, part, ids, words))
        _, inverse = np.unique(self.sig, return_inverse=True)
        self.kind, self.name = np.full(len(order), -1, np.int8), None
        self.mixed = (np.bincount(inverse, weights=self.side) > 0)[inverse] if len(inverse) else np.zeros(0, bool)

    def frame(self, k: np.ndarray, reach: int, gap: int = -1) -> np.ndarray:
        """The text up to reach to either side of the centres, gap where there is none."""
        where = np.arange(-reach, reach + 1)[None, :] + self.left[k][:, None]
        inside = (where >= 0) & (where < self.length[k][:, None])
        out = np.full(where.shape, gap, np.int64)
        out[inside] = self.flat[(self.begin[k][:, None] + where)[inside]]
        return out

    def narrow(self, k: int) -> np.ndarray:
        """The text of the class's own SPAN-long passages."""
        at = int(self.begin[k] + self.left[k] - self.back[k])
        return self.flat[at : at + int(self.back[k] - self.front[k]) + SPAN]

    def text(self, k: int) -> np.ndarray:
        return self.flat[self.begin[k] : self.begin[k] + self.length[k]]

    def _rare(self, s: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a large group that share one of the rarest shingles of both; others can't share 80 %. One of a pair is not of
        the component that most of the group belong to."""
        _, part, sizes = np.unique(self.part[s : s + n], return_inverse=True, return_counts=True)
        fewer = np.flatnonzero(part != sizes.argmax())
        least = np.full(n, -1)
        least[fewer] = np.arange(len(fewer))
        frame = self.frame(np.arange(s, s + n), REACH)
        row, col = np.nonzero(frame >= 0)
        cell = np.unique(row.astype(np.uint64) << np.uint64(32) | frame[row, col].astype(np.uint64))
        row = (cell >> np.uint64(32)).astype(np.int64)
        _, inverse, df = np.unique(cell.astype(np.uint32), return_inverse=True, return_counts=True)
        total = np.bincount(row, minlength=n)
        need, known = np.full(n, ENOUGH), {}
        for k in np.flatnonzero(total < self.length[s : s + n]).tolist():
            x = self.narrow(s + k)
            if (name := x.tobytes()) not in known:
                known[name] = min(ENOUGH, *(-(-8 * len(set(x[j : j + SPAN].tolist())) // 10) for j in range(len(x) - SPAN + 1)))
            need[k] = known[name]
        order = np.lexsort((inverse, df[inverse], row))
        row, word = row[order], inverse[order]
        rank = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        keep = (rank <= (total - need)[row]) & (df[word] > 1)
        row, word = row[keep], word[keep]
        keep = (np.bincount(word[least[row] >= 0], minlength=len(df)) > 0)[word]
        row, word = row[keep], word[keep]
        found = np.zeros((len(fewer), n), bool)
        for _, p in _split(word):
            own = row[p]
            if len(own) > 1:
                at = least[own]
                found[np.ix_(at[at >= 0], own)] = True
        i, j = np.nonzero(found)
        i = fewer[i]
        # Two that are both of smaller components were found twice.
        keep = (part[i] != part[j]) & ((least[j] < 0) | (i < j))
        i, j = i[keep], j[keep]
        return s + np.minimum(i, j), s + np.maximum(i, j)

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of classes under one signature and the first one's place in its group."""
        edge = np.ones(len(self.sig), bool)
        edge[1:] = self.sig[1:] != self.sig[:-1]
        starts = np.flatnonzero(edge)
        sizes = np.diff(np.append(starts, len(self.sig)))
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]).tolist():
            i, j = np.triu_indices(n, 1)
            for own in np.array_split(starts[sizes == n], -(-int((sizes == n).sum()) * len(i) // (1 << 20))):
                p, q = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
                keep = self.part[p] != self.part[q]
                first.append(p[keep])
                second.append(q[keep])
        for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            i, j = self._rare(s, n)
            first.append(i)
            second.append(j)
        a, b = np.concatenate(first), np.concatenate(second)
        two = (self.side[a] == self.side[b]) & self.mixed[a]
        keep = np.flatnonzero(~two & (self.part[a] != self.part[b]))
        # Where shingles repeat near the centre, only a window's own passages are compared.
        own = self.words[a[keep]]
        own = np.where((self._repeats(a[keep]) == 2) | (self._repeats(b[keep]) == 2), -1 - own, own // STEP)
        place = np.stack((self.ids[a[keep]], self.ids[b[keep]], self.words[a[keep]] - self.words[b[keep]], own))
        with np.errstate(over="ignore"):
            name = np.zeros(len(keep), np.uint64)
            for x in place:
                name = _mix(name * np.uint64(3) + x.astype(np.uint64), 300)
        keep = keep[np.sort(np.unique(name, return_index=True)[1])]
        a, b = a[keep], b[keep]
        return a, b, a - np.repeat(starts, sizes)[a]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked windows: enough pairs to join the components of documents that belong together."""
        a, b, _ = self.candidates()
        _, node = np.unique(self.part, return_inverse=True)
        stars, found = Stars(int(node.max()) + 1 if len(node) else 0), [np.zeros((2, 0), np.int64)]
        # One pair of windows for each pair of components, then one more, then two, four and so on, while they aren't joined.
        both = np.minimum(node[a], node[b]) * np.int64(len(node) + 1) + np.maximum(node[a], node[b])
        order = np.argsort(both, kind="stable")
        a, b, both = a[order], b[order], both[order]
        nth = np.arange(len(a)) - np.searchsorted(both, both)
        turn = np.frexp(nth + 1)[1]
        for k in np.unique(turn).tolist():
            p, q, root = a[turn == k], b[turn == k], stars.flush()
            open_ = root[node[p]] != root[node[q]]
            p, q = self._likely(p[open_], q[open_])
            for at in range(0, len(p), 1024):
                root = stars.flush()
                x, y = p[at : at + 1024], q[at : at + 1024]
                open_ = root[node[x]] != root[node[y]]
                if not open_.any():
                    continue
                x, y, *_ = self._compare(x[open_], y[open_])
                stars.add(node[x], node[y])
                found.append(np.stack((x, y)))
        x, y = np.concatenate(found, axis=1)
        return x, y

    def pairs(self):
        """(class, class, start and end in each, shared) of the pairs that have passages that share 80 %; places count from
        the centres."""
        a, b, _ = self.candidates()
        for k in range(0, len(a), 1024):
            yield self._compare(a[k : k + 1024], b[k : k + 1024], True)

    def _inside(self, k: np.ndarray) -> np.ndarray:
        """Where in a frame of NEAR shingles to either side a passage of the text may start."""
        at = np.arange(2 * NEAR + 2 - SPAN)[None, :] - NEAR
        return (at >= -self.left[k][:, None]) & (at + SPAN <= (self.length - self.left)[k][:, None])

    def _compare(self, a: np.ndarray, b: np.ndarray, extents: bool = False):
        kind = np.maximum(self._repeats(a), self._repeats(b))
        near, far = np.ones((2, len(a)), bool)
        for told, test in ((0, self._close), (1, self._dense)):
            k = np.flatnonzero(kind == told)
            for p in (k[n : n + 256] for n in range(0, len(k), 256)):
                near[p], far[p] = test(a[p], b[p])
        keep = near | far
        a, b, near, far, odd = (z[keep] for z in (a, b, near, far, kind == 2))
        near &= ~odd
        x, y = self.frame(a, NEAR), self.frame(b, NEAR, -2)
        total = np.zeros((len(a), x.shape[1] + 1), np.int16)
        np.cumsum(x == y, axis=1, out=total[:, 1:])
        count = total[:, SPAN:] - total[:, :-SPAN]
        inside = self._inside(a), self._inside(b)
        hit = (count >= ENOUGH) & inside[0] & inside[1] & near[:, None]
        sure = hit.any(axis=1)
        out = [np.zeros((0, 7), np.int64)]

        def put(p, i, j, k, n, shared):
            out.append(np.stack((a[p], b[p], i, j, k, n, shared), axis=1).astype(np.int64))

        k = np.flatnonzero(sure)
        first, end = hit[k].argmax(axis=1) - NEAR, hit.shape[1] - NEAR + SPAN - 1 - hit[k][:, ::-1].argmax(axis=1)
        put(k, first, end, first, end, count[k].max(axis=1))
        k = np.flatnonzero(~sure & near)
        both = np.sort(np.concatenate((x[k], y[k]), axis=1), axis=1)
        k = k[((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).sum(axis=1) >= ENOUGH]
        for p in (k[n : n + 64] for n in range(0, len(k), 64)):
            shared = overlaps(x[p], y[p])
            hit = (shared >= ENOUGH) & inside[0][p][:, :, None] & inside[1][p][:, None, :]
            p, shared, hit = (z[hit.any(axis=(1, 2))] for z in (p, shared, hit))
            i, j = hit.any(axis=2), hit.any(axis=1)
            sure[p] = True
            stop = i.shape[1] - NEAR + SPAN - 1
            put(p, i.argmax(axis=1) - NEAR, stop - i[:, ::-1].argmax(axis=1), j.argmax(axis=1) - NEAR, stop - j[:, ::-1].argmax(axis=1), shared.max(axis=(1, 2)))
        for k in np.flatnonzero(odd).tolist():
            if got := similar(self.narrow(a[k]), self.narrow(b[k])):
                i, j, n = (np.array(z) for z in zip(*got, strict=True))
                sure[k] = True
                u, v = int(self.back[a[k]]), int(self.back[b[k]])
                put(np.array([k]), *(np.array([z]) for z in (i.min() - u, i.max() + SPAN - u, j.min() - v, j.max() + SPAN - v, n.max())))
        # Longer passages of different lengths, which share ENOUGH different shingles.
        k = np.flatnonzero(far & ~sure) if not extents else np.flatnonzero(far)
        for k in np.concatenate([np.zeros(0, np.int64), *(p[self._shared(a[p], b[p]) >= ENOUGH] for p in (k[n : n + 256] for n in range(0, len(k), 256)))]).tolist():
            if got := stretch(self.text(a[k]), self.text(b[k])):
                u, v = int(self.left[a[k]]), int(self.left[b[k]])
                put(np.array([k]), *(np.array([z]) for z in (got[0] - u, got[1] - u, got[2] - v, got[3] - v, got[4])))
        return tuple(np.concatenate(out).T)

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many different shingles the texts of each pair have in common."""
        name = []
        for side, k in enumerate((a, b)):
            row = np.repeat(np.arange(len(k)), self.length[k])
            at = np.repeat(self.begin[k] - (np.cumsum(self.length[k]) - self.length[k]), self.length[k]) + np.arange(len(row))
            name.append((row.astype(np.uint64) << np.uint64(32) | self.flat[at].astype(np.uint64)) << np.uint64(1) | np.uint64(side))
        name = np.concatenate(name)
        name.sort()
        name = name[np.append(True, name[1:] != name[:-1])] if len(name) else name
        both = np.flatnonzero(name[1:] >> np.uint64(1) == name[:-1] >> np.uint64(1))
        return np.bincount((name[both] >> np.uint64(33)).astype(np.int64), minlength=len(a))

    def _repeats(self, k: np.ndarray) -> np.ndarray:
        """Whether a shingle comes again in the text (1) and near the centre (2)."""
        new = np.unique(k)
        new = new[self.kind[new] < 0]
        for p in (new[n : n + 4096] for n in range(0, len(new), 4096)):
            self.kind[p] = 0
            for kind, reach in ((1, REACH), (2, NEAR)):
                f = np.sort(self.frame(p, reach), axis=1)
                self.kind[p[((f[:, 1:] == f[:, :-1]) & (f[:, 1:] >= 0)).any(axis=1)]] = kind
        return self.kind[k]

    def _likely(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs without those that can't be linked, for texts without repetition: passages that share 80 % have shingles
        in common, the first and last of which in b's order are at least ENOUGH - 1 apart and, counted as in `stretch`,
        have a sum that isn't negative."""
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        plain = np.flatnonzero((self._repeats(a) == 0) & (self._repeats(b) == 0))
        if not len(plain):
            return a, b
        if self.name is None:
            values, self.name = np.unique(self.flat, return_inverse=True)
            self.table = np.full(len(values) + 1, -1, np.int16)
        keep, place = np.ones(len(a), bool), np.arange(2 * REACH + 1)
        for p in (plain[n : n + 4096] for n in range(0, len(plain), 4096)):
            k, line = np.unique(b[p], return_inverse=True)
            inside = place[None, :] < self.length[k][:, None]
            text = np.full(inside.shape, len(self.table) - 1)
            text[inside] = self.name[(self.begin[k][:, None] + place)[inside]]
            met = np.empty((len(p), len(place)), np.int16)
            first = np.flatnonzero(np.append(True, a[p[1:]] != a[p[:-1]]))
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(p)], strict=True):
                x = a[p[s]]
                own = self.name[self.begin[x] : self.begin[x] + self.length[x]]
                self.table[own] = place[: len(own)]
                met[s:e] = self.table[text[line[s:e]]]
                self.table[own] = -1
            shared = met >= 0
            score = 9 * np.cumsum(shared, axis=1, dtype=np.int16) - 4 * (met + place.astype(np.int16))
            low = np.minimum.accumulate(np.where(shared, score, np.int16(10_000))[:, : len(place) - ENOUGH + 1], axis=1)
            keep[p] = (np.where(shared, score, np.int16(-10_000))[:, ENOUGH - 1 :] - low >= -1).any(axis=1)
        return a[keep], b[keep]

    def _close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether two texts without repetition can hold SPAN-long passages that share 80 %, and whether longer ones can: of
        the shingles that both have, ENOUGH stand in SPAN places of each; or from one to another at least ENOUGH - 1 later
        the sum that `stretch` counts, without its least widths, isn't negative."""
        names = []
        for side, k in enumerate((a, b)):
            row = np.repeat(np.arange(len(k)), self.length[k])
            at = np.arange(len(row)) - np.repeat(np.cumsum(self.length[k]) - self.length[k], self.length[k])
            value = self.flat[np.repeat(self.begin[k], self.length[k]) + at]
            names.append((row << 32 | value) << 9 | side << 8 | at)
        name = np.concatenate(names)
        name.sort()
        same = np.flatnonzero(name[1:] >> 9 == name[:-1] >> 9)
        row = name[same] >> 41
        n = np.bincount(row, minlength=len(a))
        enough = n[row] >= ENOUGH
        near, far = np.zeros((2, len(a)), bool)
        if not enough.any():
            return near, far
        same, row = same[enough], row[enough]
        i, j = name[same] & 255, name[same + 1] & 255
        tight = []
        for x in (i, j):
            x = np.sort(row << 8 | x)
            k = np.flatnonzero(x[ENOUGH - 1 :] - x[: 1 - ENOUGH] < SPAN)
            k = k[x[k] >> 8 == x[k + ENOUGH - 1] >> 8]
            tight.append(np.bincount(x[k] >> 8, minlength=len(a)) > 0)
        near = tight[0] & tight[1]
        order = np.argsort(row << 8 | i)
        row, i, j = row[order], i[order], j[order]
        rows, line, n = np.unique(row, return_inverse=True, return_counts=True)
        nth = np.arange(len(row)) - (np.cumsum(n) - n)[line]
        score = np.full((len(rows), n.max()), -(1 << 20))
        score[line, nth] = 9 * nth - 4 * i - 4 * j
        least = np.minimum.accumulate(np.where(score > -(1 << 20), score, 0)[:, : score.shape[1] - ENOUGH + 1], axis=1)  # the first isn't above 0
        far[rows] = (score[:, ENOUGH - 1 :] - least).max(axis=1) >= -1
        return near, far

    def _dense(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text has SPAN or more shingles in a row of which the other has 80 % somewhere; no two passages can share
        80 % otherwise (for texts without repetition). Counting one for a shared shingle and minus four for another, the sum isn't negative."""
        x = np.stack((self.frame(a, REACH), self.frame(b, REACH)), axis=1)
        width = x.shape[2]
        row, side, at = np.nonzero(x >= 0)
        packed = ((row.astype(np.uint64) << np.uint64(32) | x[row, side, at].astype(np.uint64)) << np.uint64(1) | side.astype(np.uint64)) << np.uint64(8) | at.astype(np.uint64)
        packed.sort()
        name, side = packed >> np.uint64(9), (packed >> np.uint64(8) & np.uint64(1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(name)))
        both = np.repeat((side[first] == 0) & (side[first + size - 1] == 1), size)
        score = np.full(x.shape, -4, np.int16)
        score[x < 0] = -1000
        score[(name >> np.uint64(32)).astype(np.int64)[both], side[both], (packed & np.uint64(255)).astype(np.int64)[both]] = 1
        total = np.zeros((*x.shape[:2], width + 1), np.int32)
        np.cumsum(score, axis=2, out=total[:, :, 1:])
        least = np.minimum.accumulate(total[:, :, : width + 1 - SPAN], axis=2)
        out = ((total[:, :, SPAN:] - least).max(axis=2) >= 0).all(axis=1)
        return out, out


def _classes_of(left) -> Classes:
    return Classes([_unpack(d) for d in left.column("data").to_pylist()])


def _linked(key, table):
    """Links of documents, packed: each with the smaller id and its own centre."""
    c = _classes_of(table)
    x, y = c.joined()
    low = np.minimum(c.ids[x], c.ids[y])
    return pa.table({"data": pa.array([_told(np.concatenate((c.ids[x], c.ids[y])), np.concatenate((low, low)), np.concatenate((c.words[x], c.words[y])))] if len(x) else [], pa.binary())})


LINKS = "a long, b long, a_word long, b_word long, length long, shared int"


def _spelled(key, table):
    """A row for every two windows that are linked."""
    c = _classes_of(table)
    found = [np.zeros((7, 0), np.int64)]
    for block in c.pairs():
        x = np.stack(block)
        found.append(x[:, c.ids[x[0]] != c.ids[x[1]]])
    p, q, a1, a2, b1, b2, shared = np.concatenate(found, axis=1)
    swap = c.ids[p] > c.ids[q]
    ids, at = (c.ids[p], c.ids[q]), (c.words[p] + a1, c.words[q] + b1)
    pick = lambda x, k: np.where(swap, x[1 - k], x[k])
    columns = (pick(ids, 0), pick(ids, 1), pick(at, 0), pick(at, 1), np.maximum(a2 - a1, b2 - b1), shared.astype(np.int32))
    return pa.table([pa.array(x) for x in columns], ["a", "b", "a_word", "b_word", "length", "shared"])


class Search:
    """The steps that links and classes have in common."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, spelled: bool):
        self.n = n = common.partitions_for(docs)
        buckets = common.buckets_for(n)
        frame = docs.select(
            common.chunk_of(id_col, text_col, n), F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").cast("binary").alias("__text")
        )
        self.chunks = frame.repartition(n, "chunk").groupBy("chunk")
        marks = self.chunks.applyInArrow(_keys(buckets), "bucket int, chunk int, data binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_repeated, "chunk int, bucket int, data binary")
        met = self.chunks.cogroup(marks.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_met(buckets, spelled), "bucket int, chunk int, data binary")
        self.found = common.checkpointed(met.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_groups(buckets, spelled), LEFT))
        self.buckets = buckets

    def told(self) -> DataFrame:
        """(doc_id, low, word): the documents that are joined with a smaller one."""
        shares = self.found.filter("data is not null").select("chunk", "data").repartition(self.buckets, "chunk")
        return shares.groupBy("chunk").applyInArrow(_once, NAMED)

    def compared(self, parts: DataFrame, schema: str, run) -> DataFrame:
        """run over the windows that have to be compared, by task. parts: (node, root) of documents."""
        left = self.found.filter("data is null").drop("data").join(parts.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("part", F.coalesce("root", "doc_id")).drop("root")
        left = left.select("sig", "chunk", "doc", "centre", "steps", "doc_id", "part")
        wide = left.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k")).filter("parts > 1")
        # All that a component shares with others goes to one task, where it isn't too much, or else what two components share
        # under signatures of their own (in several tasks where that is much); so what is joined once isn't compared again.
        ways = (F.floor(F.sum("k") / TASK) + 1).alias
        own = wide.groupBy(F.col("low").alias("first")).agg(ways("all_ways"))
        met = wide.filter("parts = 2").groupBy(F.col("low").alias("l"), F.col("high").alias("h")).agg(ways("ways"))
        wide = wide.join(own, F.col("low") == F.col("first")).join(met, (F.col("parts") == 2) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")), "left")
        name = F.when(F.col("all_ways") == 1, F.xxhash64("low")).when(F.col("parts") == 2, F.xxhash64("low", "high", F.pmod(F.xxhash64("sig"), "ways"))).otherwise(F.xxhash64("sig"))
        wide = wide.select(F.col("sig").alias("s"), name.alias("name"), F.floor((F.col("k") + (BLOCK - 1)) / BLOCK).cast("int").alias("pieces"))
        dealt = left.join(wide, F.col("sig") == F.col("s")).withColumn("own", F.pmod(F.xxhash64("doc_id", "centre"), F.col("pieces")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        task = F.when(F.col("pieces") == 1, F.pmod("name", F.lit(self.n))).otherwise(self.n + F.pmod(F.xxhash64("sig", i, j), F.lit(1 << 61)))
        asked = dealt.select("chunk", task.alias("task"), "sig", (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "centre", "steps", "doc_id", "part")
        answers = self.chunks.cogroup(asked.repartition(self.n, "chunk").groupBy("chunk")).applyInArrow(_answers, "task long, data binary")
        return answers.repartition(self.n, "task").groupBy("task").applyInArrow(run, schema)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, a_word, b_word, length, shared): all verified passages of two documents (a < b), each over its whole extent: the
    words where it starts, its length in shingles, and the most shingles that a pair of passages in it shares. What overlaps
    along one diagonal is one passage. A row for every pair, so many for a passage that many documents hold; classes()
    needs none."""
    search = Search(docs, id_col, text_col, True)
    alone = docs.sparkSession.createDataFrame([], "node long, root long")
    found = search.compared(alone, LINKS, _spelled).withColumn("d", F.col("b_word") - F.col("a_word"))
    before = Window.partitionBy("a", "b", "d").orderBy("a_word", "length").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("a", "b", "d").orderBy("a_word", "length").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("a_word") > F.max(F.col("a_word") + F.col("length")).over(before), F.lit(True))
    merged = found.withColumn("new", new.cast("int")).withColumn("k", F.sum("new").over(upto)).groupBy("a", "b", "d", "k")
    return merged.agg(F.min("a_word").alias("a_word"), F.min("b_word").alias("b_word"), (F.max(F.col("a_word") + F.col("length")) - F.min("a_word")).alias("length"), F.max("shared").alias("shared")).drop("d", "k")


NAMED = "doc_id long, low long, word long"


def _once(key, table):
    """The links of a share's documents, each once and with its smallest word."""
    ids, low, word = (np.concatenate(x) for x in zip(*(_unpack(d) for d in table.column("data").to_pylist()), strict=True))
    order = np.lexsort((word, low, ids))
    ids, low, word = ids[order], low[order], word[order]
    first = np.append(True, (ids[1:] != ids[:-1]) | (low[1:] != low[:-1]))
    return pa.table([pa.array(ids[first]), pa.array(low[first]), pa.array(word[first].astype(np.int64))], ["doc_id", "low", "word"])


def _opened(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            ids, low, word = _unpack(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low), pa.array(word.astype(np.int64))], ["doc_id", "low", "word"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, first_word): for every document that shares a passage, the smallest doc_id reachable over links and
    the first word of the first of its shared shingles that a link was found by; it lies inside a shared passage."""
    search = Search(docs, id_col, text_col, False)

    def edges(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("a"), F.col("low").alias("b"))

    equal = common.checkpointed(search.told())
    parts = common.checkpointed(components(edges(equal)))
    found = search.compared(parts, "data binary", _linked).mapInArrow(_opened, NAMED)
    near = common.checkpointed(found.groupBy("doc_id", "low").agg(F.min("word").alias("word")))
    # What was compared joins components, which are few beside the documents.
    headed = lambda rows, c: rows.join(parts.select(F.col("node").alias(c), F.col("root").alias(f"{c}_head")), c, "left").withColumn(c, F.coalesce(f"{c}_head", c)).drop(f"{c}_head")
    above = components(headed(headed(edges(near), "a"), "b")).select(F.col("node").alias("head"), "root")
    first = equal.unionByName(near).groupBy("doc_id").agg(F.min("word").alias("first_word")).withColumn("head", F.col("doc_id"))
    return headed(first, "head").join(above, "head", "left").select("doc_id", F.coalesce("root", "head").alias("class_id"), "first_word")
