"""The corpus pipeline against a sequential version of every stage, on the smallest tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from glossa.llm import common, langid, toxicity
from tests.conftest import SF
from tests.llm.test_operators import hf, prose, roots


def signed_hash(i):
    return int(np.array([xxhash.xxh64_intdigest(str(i).encode(), 42)], np.uint64).view(np.int64)[0])


def start_of(i, size):
    """Where the piece that is learned from a text of that size starts."""
    seed = xxhash.xxh64_intdigest(str(i).encode(), 42)
    signed = int(np.array([xxhash.xxh64_intdigest(b"start", seed)], np.uint64).view(np.int64)[0])
    return signed % (max(size - langid.PIECE_BYTES, 0) + 1)


def crc(i):
    return zlib.crc32(str(i).encode())


def plain_language_id(docs):
    own = {}
    for r in docs:
        if crc(r.doc_id) % 4 != 2 and r.text is not None and r.lang is not None:
            own.setdefault(r.lang, []).append((signed_hash(r.doc_id), r.text[start_of(r.doc_id, len(r.text)) :][: langid.PIECE_BYTES]))
    model = {}
    for lang, rows in own.items():
        pieces = dict.fromkeys(langid.clean(p) for _, p in sorted(rows)[: langid.SAMPLE_DOCS])
        model[lang] = " ".join(reversed(pieces)).encode()[-langid.DICTIONARY_BYTES :]
    scorer, out = langid.Scorer(model), []
    for r in docs:
        lang, _, margin = scorer.predict(r.text.encode())
        if lang != "und" and margin >= langid.MIN_MARGIN:
            out.append(r)
    return out


def plain_toxicity(docs, labels):
    count = {0: Counter(), 1: Counter()}
    train = [(r, labels[r.doc_id]) for r in docs if r.doc_id in labels and crc(r.doc_id) % 5]
    for r, y in train:
        count[y].update(toxicity.words_of(r.text))
    names = sorted(count[0].keys() | count[1].keys())
    code, owner, _ = toxicity.codes_of(names)
    keys, inverse = np.unique(code, return_inverse=True)
    t, o = (np.bincount(inverse, weights=np.array([count[y][names[k]] for k in owner], float)).astype(np.int64) for y in (1, 0))
    model = toxicity.ratios(keys.astype(np.int64), t, o)
    judge = toxicity.Judge(model)
    model["curve"] = toxicity.fit(judge.figures([r.text for r, _ in train]), np.array([y == 1 for _, y in train]))
    return [r for r, s in zip(docs, toxicity.scores(judge, [r.text for r in docs]), strict=True) if s < 0.5]


def near_pairs(texts):
    """Pairs of texts that share 80 % of their five-word shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)]))
    return [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def plain_suffixes(rows):
    """Each text without bytes that a window seen before covers; a character that is cut in two goes."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        data = r.text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(data[k : k + 100])
        out[r.doc_id] = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "suffix_dedup", "packing"]
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    kept = common.checkpointed(stage["language_id"](spark, docs, SF))
    want = plain_language_id(rows)
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == {r.doc_id for r in want} and len(want) > 0.9 * len(rows)

    docs, rows = kept, want
    kept = common.checkpointed(stage["toxicity"](spark, docs, SF))
    want = plain_toxicity(rows, labels)
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == {r.doc_id for r in want}

    docs, rows = kept, sorted(want, key=lambda r: r.doc_id)
    kept = common.checkpointed(stage["near_dedup"](spark, docs, SF))
    root = roots(len(rows), near_pairs([r.text for r in rows]))
    want = [r for k, r in enumerate(rows) if root[k] == k]
    assert kept.columns == names and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in want)

    docs, rows = kept, want
    kept = common.checkpointed(stage["suffix_dedup"](spark, docs, SF))
    left = kept.collect()
    assert kept.columns == names and {r.doc_id: r.text for r in left} == plain_suffixes(rows) and all(r.n_chars == len(r.text) for r in left)

    tool, pieces = hf(), {}
    for r in stage["packing"](spark, kept, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {r.doc_id for r in left}
    for r in left:
        ids, at = [*tool.encode(r.text, add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_odd_rows_pass_every_stage(spark):
    """Nulls, empty and very long texts, repeated rows and ids, ids that are null, and further columns."""
    rng = random.Random(4)
    base, other = prose(rng, 200), prose(rng, 90)
    texts = [base, base, base + " end", other, None, "", " \n", "12 34", "a", prose(rng, 30_000)]
    rows = [(k + 1, t, "en", f"s{k}", None if t is None else len(t), k, "x") for k, t in enumerate(texts)]
    rows += [rows[0], (1, other + " more words here", None, "s", 1, 9, "x"), (None, base, "en", "s", 1, 9, "x"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, component_id string").repartition(3)
    stage, size = dict(corpus_pipeline.STAGES), {}
    for name in ("language_id", "toxicity", "near_dedup", "suffix_dedup"):
        got = stage[name](spark, docs, SF)
        assert got.columns == docs.columns
        size[name] = Counter(r.doc_id for r in got.collect())
    assert not {5, 6, 7, 8} & set(size["language_id"]) and size["language_id"][10] == 1
    assert sum(size["toxicity"].values()) == len(rows) and sum(size["suffix_dedup"].values()) == len(rows)
    # Two and three are copies of one; five, six and seven have no words; the other text with id one is a copy of four's.
    assert set(size["near_dedup"]) == {1, 4, 5, 8, 9, 10, None} - ({4} if size["near_dedup"][1] == 3 else set()) and size["near_dedup"][None] == 2
    assert stage["packing"](spark, docs, SF).select("doc_id").distinct().count() == 11


@pytest.mark.parametrize("name", ["language_id", "toxicity", "near_dedup", "suffix_dedup", "packing"])
def test_stages_take_empty_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
