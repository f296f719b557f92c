"""Toxicity by class-conditional Kneser-Ney models: two character models of order 5 inside words, one of toxic and one of
ordinary documents, compared by length-normalised log-likelihood.

Each class keeps its own counts of the highest order; every lower order is a continuation distribution (absolute
discounting) counted over both classes together, so an expression that a class has hardly seen backs off to what both
share and says nothing. Words are folded to 32 symbols, so there are at most 2**25 five-symbol codes and the model has a
size bound whatever the corpus. Counting covers every labelled training document: tasks count their own words, send packed
code counts to SHARDS merging tasks by code, and only merged codes reach the driver, which turns them into log ratios.
A logistic curve over three length-normalised figures of a document is fitted on at most CALIBRATION labelled documents.

Defined results: a null or empty text gets the score of a text without evidence; with labels of one class only (or none)
every score is that class's share (or 0.0). Labels, lang, source and doc_id never enter a score. One row per input row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common

ORDER, BITS, DISCOUNT, SHARDS = 5, 5, 0.75, 64
#: Bounds: labelled documents for the calibration, distinct words a worker counts or remembers before it lets go.
CALIBRATION, WORDS_HELD = 20_000, 200_000

_WORD = re.compile(r"[^\W\d_]+")
_TOP = 1 << (ORDER * BITS)


def _symbols() -> np.ndarray:
    """Symbol of each character below 2**16: Latin letters without their accents are 1 to 26, others begin with one of five
    further symbols and have a second one."""
    out = np.zeros(1 << 16, np.uint32)
    for k in range(1 << 16):
        base = unicodedata.normalize("NFKD", chr(k))[:1].lower()
        out[k] = ord(base) - 96 if "a" <= base <= "z" else 27 + k % 5
    return out


_TABLE: list[np.ndarray] = []


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Highest-order codes of every symbol and end of the words, the index of the word of each, and symbols per word."""
    if not _TABLE:
        _TABLE.append(_symbols())
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    one = np.where(flat < 1 << 16, _TABLE[0][flat & 0xFFFF], 27 + flat % 5).astype(np.uint32)
    wide = one >= 27
    width = 1 + wide
    owner = np.repeat(np.arange(len(words)), sizes)
    count = np.bincount(owner, weights=width, minlength=len(words)).astype(np.int64)
    first = (ORDER - 1) + np.cumsum(count + ORDER - 1) - (count + ORDER - 1) if len(words) else count
    at = np.cumsum(width) - width + (first - (np.cumsum(count) - count))[owner] if len(words) else owner
    symbols = np.zeros(int((count + ORDER - 1).sum()) + ORDER, np.uint32)
    symbols[at] = one
    symbols[at[wide] + 1] = 27 + flat[wide] // 5 % 5
    code = np.zeros(len(symbols), np.uint32)
    for k in range(ORDER):
        code[k:] |= symbols[: len(symbols) - k] << np.uint32(BITS * k)
    count += 1  # the end
    owner = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return code[at], owner, count


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _packed(count: dict[int, Counter]):
    """Rows (shard, codes, toxic counts, ordinary counts) of what was counted."""
    names = list(count[0].keys() | count[1].keys())
    if not names:
        return
    code, owner, _ = codes_of(names)
    own, inverse = np.unique(code, return_inverse=True)
    sums = []
    for label in (1, 0):
        n = np.fromiter((count[label].get(w, 0) for w in names), np.float64, len(names))
        sums.append(np.bincount(inverse, weights=n[owner], minlength=len(own)).astype(np.uint32))
    shard = shard_of(own)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    parts = [order[cuts[s] : cuts[s + 1]] for s in range(SHARDS)]
    held = [s for s in range(SHARDS) if len(parts[s])]
    yield pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int32()), *(pa.array([x[parts[s]].tobytes() for s in held], pa.binary()) for x in (own.astype(np.uint32), *sums))],
        ["shard", "codes", "toxic", "ordinary"],
    )


def shard_of(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int32) % SHARDS


def _count(batches):
    held = {0: Counter(), 1: Counter()}
    for batch in common.parts(batches, 1000):
        for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[1 if label == 1 else 0].update(words_of(text))
            if len(held[0]) + len(held[1]) > WORDS_HELD:
                yield from _packed(held)
                held = {0: Counter(), 1: Counter()}
    yield from _packed(held)


def _merge(batches):
    """Adds the counts of the shards in this task; rows stream through."""
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in common.parts(batches, 1000):
        for shard, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            code, t, o = (np.frombuffer(b, np.uint32).astype(np.int64) for b in x)
            if shard in held:
                a, b, c = held[shard]
                code, t, o = np.concatenate((a, code)), np.concatenate((b, t)), np.concatenate((c, o))
                own, inverse = np.unique(code, return_inverse=True)
                code, t, o = own, np.bincount(inverse, weights=t).astype(np.int64), np.bincount(inverse, weights=o).astype(np.int64)
            held[shard] = code, t, o
    for code, t, o in held.values():
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (code, t, o)], ["codes", "toxic", "ordinary"])


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(text, label) of the documents that carry a label; several labels of one document count as their largest."""
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label")).filter("__id is not null and label is not null").groupBy("__id").agg(F.max("label").alias("label"))
    left = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    return left.join(own.hint("shuffle_hash"), "__id").select("text", "label")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """The model from documents and labels that may be learned from."""
    rows = labelled(docs, labels, label)
    counted = rows.mapInArrow(_count, "shard int, codes binary, toxic binary, ordinary binary")
    merged = counted.repartition(SHARDS, "shard").mapInArrow(_merge, "codes binary, toxic binary, ordinary binary").collect()
    code, t, o = (np.concatenate([np.frombuffer(r[k], np.int64) for r in merged] or [np.zeros(0, np.int64)]) for k in range(3))
    order = np.argsort(code)
    model = ratios(code[order], t[order], o[order])
    # Calibration on a bounded sample of the same documents.
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    total = ids.count()
    share = min(1.0, 1.5 * CALIBRATION / max(total, 1))
    sample = ids.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(CALIBRATION)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id").select("text", "label")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def figures(batches):
        judge = Judge(shared.value)
        for batch in common.parts(batches, 1000):
            x = judge.figures(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k], pa.float64()) for k in range(x.shape[1])), batch.column(1)], ["a", "b", "c", "label"])

    got = rows.mapInArrow(figures, "a double, b double, c double, label int").toPandas()
    model["curve"] = fit(got[["a", "b", "c"]].to_numpy(), (got["label"] == 1).to_numpy())
    return model


def ratios(code: np.ndarray, t: np.ndarray, o: np.ndarray) -> dict:
    """Log ratios toxic : ordinary of the codes seen, and of a context alone where the code was not seen."""
    if not len(code) or not t.sum() or not o.sum():
        return {"codes": np.zeros(0, np.uint32), "ratio": np.zeros(0, np.float32), "contexts": np.zeros(0, np.uint32), "back": np.zeros(0, np.float32)}
    # Shared continuation probabilities, from the unigram up: of a code's suffix of n symbols, given its first n - 1.
    types = [code]
    for n in range(ORDER - 1, 0, -1):
        types.append(np.unique(types[-1] & ((1 << (BITS * n)) - 1)))
    types = types[::-1]  # orders 1 to ORDER
    p = np.full(1, 1.0 / (1 << BITS))
    lower = np.zeros(1, np.int64)
    for n in range(1, ORDER):
        own, longer = types[n - 1], types[n]
        kinds = np.bincount(np.searchsorted(own, longer & ((1 << (BITS * n)) - 1)), minlength=len(own)).astype(float)
        context = own >> BITS
        names, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=kinds)
        distinct = np.bincount(inverse)
        below = p[np.searchsorted(lower, own & ((1 << (BITS * (n - 1))) - 1))] if n > 1 else np.full(len(own), p[0])
        p = (kinds - DISCOUNT + DISCOUNT * distinct[inverse] * below) / total[inverse]
        lower = own
    shared = p[np.searchsorted(lower, code & ((1 << (BITS * (ORDER - 1))) - 1))]
    names, inverse = np.unique(code >> BITS, return_inverse=True)
    logs, backs = [], []
    for c in (t, o):
        total = np.bincount(inverse, weights=c)
        distinct = np.bincount(inverse, weights=c > 0)
        back = np.where(total > 0, DISCOUNT * distinct / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[inverse] + back[inverse] * shared))
        backs.append(np.log(back))
    return {"codes": code.astype(np.uint32), "ratio": (logs[0] - logs[1]).astype(np.float32), "contexts": names.astype(np.uint32), "back": (backs[0] - backs[1]).astype(np.float32)}


class Judge:
    """Worker side: remembers the log ratio of words, at most WORDS_HELD of them at a time."""

    def __init__(self, model: dict):
        self.model, self.known, self.value, self.size = model, {}, np.zeros(0, np.float32), np.zeros(0, np.float32)

    def _learn(self, words: list[str]) -> None:
        m = self.model
        code, owner, count = codes_of(words)
        x = np.zeros(len(code), np.float32)
        if len(m["codes"]):
            at = np.minimum(np.searchsorted(m["codes"], code), len(m["codes"]) - 1)
            hit = m["codes"][at] == code
            context = code >> BITS
            c = np.minimum(np.searchsorted(m["contexts"], context), len(m["contexts"]) - 1)
            x = np.where(hit, m["ratio"][at], np.where(m["contexts"][c] == context, m["back"][c], 0)).astype(np.float32)
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.value = np.concatenate((self.value, np.bincount(owner, weights=x, minlength=len(words)).astype(np.float32)))
        self.size = np.concatenate((self.size, count.astype(np.float32)))

    def figures(self, texts: list[str | None]) -> np.ndarray:
        """For each text: mean log ratio per symbol; the largest of a word; the mean of the three largest words."""
        out = np.zeros((len(texts), 3))
        each = [words_of(t) for t in texts]
        for k in range(0, len(each), 64):
            block = each[k : k + 64]
            new = {w for words in block for w in words if w not in self.known}
            if len(new) + len(self.known) > WORDS_HELD:
                self.known, self.value, self.size = {}, np.zeros(0, np.float32), np.zeros(0, np.float32)
                new = {w for words in block for w in words}
            if new:
                self._learn(sorted(new))
            for j, words in enumerate(block):
                if words:
                    at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                    v = self.value[at]
                    top = np.partition(v, -3)[-3:] if len(v) > 3 else v
                    out[k + j] = v.sum() / self.size[at].sum(), v.max(), top.sum() / 3
        return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Logistic regression by Newton steps with a small ridge."""
    if not len(y) or y.all() or not y.any():
        return {"mean": np.zeros(3), "scale": np.ones(3), "w": np.zeros(3), "b": 0.0, "flat": float(y.mean()) if len(y) else 0.0}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, ridge = np.zeros(4), np.diag([1e-2 * len(y) ** 0.5] * 3 + [0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + ridge + 1e-9 * np.eye(4), z.T @ (y - q) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w[:3], "b": float(w[3]), "flat": None}


def scores(judge: Judge, texts: list[str | None]) -> np.ndarray:
    curve = judge.model["curve"]
    x = judge.figures(texts)
    if curve["flat"] is not None:
        return np.full(len(texts), curve["flat"])
    return 1 / (1 + np.exp(-np.clip(((x - curve["mean"]) / curve["scale"]) @ curve["w"] + curve["b"], -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(shared.value)
        for batch in common.parts(batches, 1000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(judge, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows scored below the threshold, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        judge = Judge(shared.value)
        for batch in common.parts(batches, 1000):
            yield batch.filter(pa.array(scores(judge, batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))
