"""Each training-data operator against a plain version, and on the rows that a corpus may hold."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from glossa.llm import bytebpe, common, components, langid, mpegts, neardup, packing, passages, queries, rpforest, seekable, simhash, suffixdedup, toxicity, wordbpe
from tests.conftest import SF

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mister how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, accents, control characters, clashing columns."""
    rng = random.Random(3)
    base, shared = prose(rng, 300), prose(rng, 70)
    texts = [base, base, base + " end", prose(rng, 40) + " " + shared + " " + prose(rng, 40), shared + " " + prose(rng, 60), None, "", " \n\t ", "a", "two words", "é" * 300, "ab" * 400, "x" * 3000, "12 34 !!", "naïve Ünï 中文字 ½ ²3", "a\x1cb \x00c", prose(rng, 6000), "The <|endoftext|> it's", base.upper()]
    out = [(k + 1, t) for k, t in enumerate(texts)]
    return [*out, out[0], (1, "other text with id one " + prose(rng, 30)), (None, base), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, ("en", "de", None)[k % 3], f"src{k % 2}", None if t is None else len(t), k, "c", 1.5, "n", k % 2, "f") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, chunk int, __id string, score double, node string, label int, __c0 string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def pairs(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def utf8(t):
    return (t or "").encode()


# 1: suffix arrays


def removal(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, utf8(r[1]))):
        b = utf8(t)
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("split", [2048, 2])
def test_suffix_dedup(docs, rows, empty, monkeypatch, split):
    monkeypatch.setattr(suffixdedup, "SPLIT", split)
    assert pairs(suffixdedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removal(rows)
    assert suffixdedup.digests(empty).count() == 0
    out = suffixdedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.filter("text is null").count() == 2 and out.filter("length(text) <> n_chars").count() == 0


def test_copies_reach_the_merge_once(monkeypatch):
    """A key that is split over shards gives the merge each different string once, not once for each shard."""
    monkeypatch.setattr(suffixdedup, "SPLIT", 2)
    rng = random.Random(7)
    line = bytes(rng.choice(b"abcdefgh ") for _ in range(160))
    sent = {}
    for copies in (8, 64):
        parts = []
        for k in range(copies):
            texts = [bytes(rng.choice(b"ijklmnop ") for _ in range(150)) + line for _ in range(2)]
            parts.append(pa.RecordBatch.from_pydict({"chunk": pa.array([k] * 2, pa.int32()), "__id": pa.array([2 * k, 2 * k + 1], pa.int64()), "__text": pa.array(texts, pa.binary())}))
        chunks = [pa.Table.from_batches([b]) for b in suffixdedup._chunked(parts)]
        rows = pa.concat_tables(chunks).to_pylist()
        left = {k: pa.Table.from_pylist([r for r in rows if r["chunk"] == k], chunks[0].schema) for k in range(copies)}
        key = lambda k: (pa.scalar(k),)

        def dealt(tables, by):
            table = pa.concat_tables(tables)
            for v in sorted(set(table.column(by).to_pylist())):
                yield v, table.filter(pc.equal(table.column(by), v))

        keys = [suffixdedup._keys(1)(key(k), t) for k, t in left.items()]
        marks = dict(dealt([suffixdedup._repeated(key(b), t) for b, t in dealt(keys, "bucket")], "chunk"))
        strings = [suffixdedup._strings(1, 16)(key(k), t, marks[k]) for k, t in left.items()]
        routed = [suffixdedup._shard(4)(key(v), t) for v, t in dealt(strings, "shard")]
        lists = [suffixdedup._unpack(d) for t in routed for c, d in zip(t.column("chunk").to_pylist(), t.column("data").to_pylist()) if c < 0]
        sent[copies] = sum(int(x[5].sum()) for x in lists), sum(len(x[6]) for x in lists)
        spans = [suffixdedup._merge(key(v), t) for v, t in dealt(routed, "route")]
        gone = 0
        told = dict(dealt(spans, "chunk"))
        for k, t in left.items():
            own = suffixdedup.Chunk(suffixdedup._rows(t))
            gone += sum(int(x[1::2].sum() - x[0::2].sum()) for x in suffixdedup.removed(own.texts, told.get(k, spans[0].slice(0, 0))))
        assert gone >= (2 * copies - 1) * len(line)
    # Windows that hold nothing but the line are sent once; those that begin before it are as many as the documents.
    inside = len(line) - 99
    assert sent[64][0] - inside <= 9 * (sent[8][0] - inside)
    assert sent[64][1] < 40 * sent[64][0]


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for text in (b"", b"a", b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaa", bytes(rng.choice(b"ab\0") for _ in range(700)), b"\0\0\0\1\0\0\0"):
        x = np.frombuffer(text, np.uint8)
        if not len(x):
            continue
        order, rank = suffixdedup.suffix_array(x)
        want = sorted(range(len(text)), key=lambda k: text[k:])
        assert order.tolist() == want and all(rank[k] == p for p, k in enumerate(want))
        prefix = suffixdedup.common_prefixes(x, order, most=10**6, lane=17)
        for a, b in zip(want, want[1:]):
            n = 0
            while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert prefix[b] == n


# 2: random-projection trees


def test_nearest(spark, empty):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 8)).round(2)
    x[50:80] = x[49]
    vectors = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [0.0] * 6), (904, []), (None, [1.0] * 8), (905, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = {}
    for r in rpforest.nearest(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 700, 50))
    hits = total = 0
    for q, mine in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(k) for k in np.lexsort((np.arange(700), d)) if k != q][:5]
        assert sorted(mine) == [1, 2, 3, 4, 5] and all(abs(d[v] - s) < 1e-12 for v, s in mine.values())
        hits, total = hits + len({v for v, _ in mine.values()} & set(want)), total + 5
    assert hits / total >= 0.9
    small = df.filter("vec_id < 200")
    for r in rpforest.nearest(small, small.filter("vec_id = 50"), 10).orderBy("rank").collect():
        want = [int(k) for k in np.lexsort((np.arange(200), np.sqrt(((x[:200] - x[50]) ** 2).sum(1)))) if k != 50]
        assert r.vec_id == want[r["rank"] - 1]
    assert rpforest.nearest(df.filter("false"), df.filter("false"), 5).count() == 0
    assert rpforest.nearest(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 10).count() == 2
    twice = df.filter("vec_id < 100").unionByName(df.filter("vec_id = 7"))
    got = rpforest.nearest(twice, twice.filter("vec_id = 7"), 3).collect()
    assert len(got) == 3 and all(r.vec_id != 7 for r in got)


def test_forest_ranks_few_rows(spark):
    """Recall at ten and the share of rows that a query is compared with, on vectors that fill all dimensions evenly and on
    clustered ones."""
    rng = np.random.default_rng(5)
    for x, most in ((rng.standard_normal((6000, 32)), 0.5), (np.repeat(rng.standard_normal((300, 32)), 20, axis=0) + 0.01 * rng.standard_normal((6000, 32)), 0.35)):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = rpforest.nearest(df, df.filter("vec_id % 100 = 0"), 10).toPandas()
        hits = 0
        for q, own in got.groupby("query_id"):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hits += len(set(np.argsort(d)[:10].tolist()) & set(own["vec_id"]))
        assert hits >= 0.9 * 600 and got["ranked"].mean() <= most * 6000


# 3 and 10: classifiers


def test_language_id(spark, docs, empty):
    big = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(big.filter(~langid.held_out()))
    assert set(model) == {"de", "en", "es", "fr"} and all(len(d) <= langid.DICTIONARY_BYTES for d in model.values())
    got = langid.predict(big, model).join(big.select("doc_id", "lang"), "doc_id").filter(langid.held_out())
    assert got.filter("lang = lang_pred").count() / got.count() >= 0.9
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {6, 7, 8, 14} <= und and 1 not in und
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (6, 7, 8, 14)").count() == 0
    assert langid.predict(empty, model).count() == 0 and langid.learn(empty) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    big, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learn(big.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    got = toxicity.score(big, model).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) / len(got) >= 0.95
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows) and all(r.score < 0.5 for r in rows if r.doc_id in (6, 7, 8))
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.learn(big, labels.filter("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    odd = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    assert toxicity.labelled(big, odd).count() == labels.filter("toxic is not null").join(big, "doc_id").count()


def test_equal_classes_give_no_ratio():
    code, _, _ = toxicity.codes_of(["abba", "abab", "baab"])
    own, n = np.unique(code, return_counts=True)
    m = toxicity.ratios(own.astype(np.int64), n.astype(np.int64), n.astype(np.int64))
    assert np.allclose(m["ratio"], 0, atol=1e-6) and np.allclose(m["back"], 0, atol=1e-6)
    skew = toxicity.ratios(own.astype(np.int64), n * (np.arange(len(n)) % 2 == 0), n)
    assert np.isfinite(skew["ratio"]).all() and (skew["ratio"] != 0).any()


# 4: transport streams


def test_transport_streams(docs, rows, empty):
    got = mpegts.read(mpegts.store(docs)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        b = utf8(t)
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = [r for r in got if r.payload_sha256 == got[0].payload_sha256]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1
    assert mpegts.read(mpegts.store(empty)).count() == 0


def test_broken_streams():
    payload = bytes(range(256)) * 9 * 90
    good = mpegts.mux(payload)
    back, seen = mpegts.demux(good)
    assert back == payload and len(seen["pts"]) == -(-len(payload) // mpegts.AU_BYTES) and len(seen["random_access"]) == -(-len(seen["pts"]) // mpegts.GROUP)
    for bad in (b"", good[:-1], good[: 188 * 5] + good[188 * 6 :], b"\0" + good[1:], good[:20] + b"\7" + good[21:]):
        with pytest.raises(mpegts.BrokenStream):
            mpegts.demux(bad)


# 5, 7, 8: tokens


def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))


def test_word_bpe_equals_library(rows):
    tool, own = hf(), wordbpe.encoder("word_bpe_49k.json")
    for t in [*(t for _, t in rows), "ΑΣ Σ ﬁ é İ", "it's I'LL don'T", "a\u2028b\u00a0c", "''s's"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == (tool.encode(t, add_special_tokens=False).ids if t else [])


def test_word_bpe_forgets_without_harm(rows, monkeypatch):
    own, few = wordbpe.encoder("word_bpe_49k.json"), wordbpe.Encoder(common.tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(wordbpe, "HELD", 5)
    for _, t in rows[:8]:
        assert few.encode(t) == own.encode(t) and len(few.new) <= 5


def test_rows_without_id_are_ordered(spark):
    """Texts without id lie in several chunks; exactly one copy of what they share stays."""
    rng = random.Random(6)
    shared = prose(rng, 60)
    df = spark.createDataFrame([(None, f"{prose(rng, 20)} {shared} {prose(rng, 20)}") for _ in range(9)], "doc_id long, text string")
    got = suffixdedup.digests(df).collect()
    assert sum(r.n_removed > 300 for r in got) == 8 and sum(r.n_removed == 0 for r in got) == 1


def test_packing(docs, rows, empty):
    tool = hf()
    got = packing.pack(docs).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*(tool.encode(t, add_special_tokens=False).ids if t else []), 1])
    covered, length, ends = Counter(), Counter(), {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
        length[r.sequence_id] += r.length
        covered[r.doc_id] += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert covered == Counter({i: sum(map(len, x)) for i, x in ids.items()}) and max(length.values()) <= 2048
    assert sum(1 for n in length.values() if n & (n - 1)) <= 3  # a short one per partition at most
    assert packing.pack(empty).count() == 0


def test_packer_properties():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.integers(1, 5000), max_size=40), st.integers(1, 7))
    def check(sizes, every):
        p, windows = packing.Packer(), []
        for k, n in enumerate(sizes):
            p.add(k, n)
            if k % every == 0:
                windows += p.round(False)
        windows += p.round(True)
        have = {}
        for w in windows:
            assert sum(n for _, _, n in w) <= 2048
            for key, start, n in w:
                have.setdefault(key, []).append((start, n))
        assert sum(1 for w in windows if sum(n for _, _, n in w) not in packing.TIERS) <= 1
        for k, n in enumerate(sizes):
            at = 0
            for start, m in sorted(have[k]):
                assert start == at
                at += m
            assert at == n
        groups = packing.step_groups([sum(n for _, _, n in w) for w in windows], 4096)
        assert len(groups) == len(windows)

    check()


def test_seekable_files(spark, docs, rows, empty):
    tool = hf()
    files = seekable.write(docs)
    got = seekable.read(spark, files).collect()
    want = Counter()
    for i, t in rows:
        x = np.array([*(tool.encode(t, add_special_tokens=False).ids if t else []), 2], "<u4")
        want[(i, len(x), zlib.crc32(x.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
    known = [r.doc_id for r in by_start if r.doc_id is not None]
    assert known == sorted(known)
    none = seekable.write(empty)
    assert seekable.read(spark, none).count() == 0


def test_seekable_files_hold_wide_ids_and_are_written_again(tmp_path):
    from pyarrow import fs

    data = b"".join(seekable.write_file([(1, np.array([70_000, 5], "<u4").tobytes())], 4))
    assert seekable.Reader(io.BytesIO(data), len(data)).ids(0).tolist() == [70_000, 5]
    with pytest.raises(ValueError):
        b"".join(seekable.write_file([(1, np.array([70_000], "<u4").tobytes())], 2))
    store = fs.LocalFileSystem()
    for text in ("first", "second"):
        (tmp_path / "held").write_text(text)
        seekable.replace(store, str(tmp_path / "held"), str(tmp_path / "target"))
    assert (tmp_path / "target").read_text() == "second" and not (tmp_path / "held").exists()


def test_byte_bpe_of_shuffled_rows(docs):
    """Rows that come out of an exchange have no order; the operator writes them first."""
    mixed = docs.repartition(5).filter("doc_id is not null")
    assert "Exchange" in mixed._jdf.queryExecution().executedPlan().toString()
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert pairs(bytebpe.digests(mixed), *columns) == pairs(bytebpe.digests(docs.filter("doc_id is not null")), *columns)


def test_shared_folder_needs_a_setting_on_a_cluster():
    from glossa import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_base(Session())


def test_damaged_streams_are_rows(spark):
    good = mpegts.mux(mpegts.padded(b"text"))
    rows = [(1, 4, good), (2, 4, good[:-1]), (3, 4, None), (4, 4, b""), (5, 4, bytes(188)), (6, 4, good[:4] + b"\xff" * 184 + good[188:])]
    got = {r.doc_id: r for r in mpegts.read(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == 6 and got[1].payload_bytes == 576 and not got[1].feature.startswith("damaged")
    assert all(got[k].payload_sha256 is None and got[k].feature.startswith("damaged") for k in (2, 3, 4, 5, 6))


def test_every_program_table_is_checked():
    payload = mpegts.padded(b"long text " * 12_000)
    good = mpegts.mux(payload)
    assert mpegts.demux(good)[0] == payload
    tables = [k for k in range(0, len(good), 188) if good[k + 1] & 0x1F == 0 and good[k + 2] == 0]
    assert len(tables) > 2
    for at in tables[1:]:
        for packet in (at, at + 188):  # the association table and the map after it
            broken = bytearray(good)
            broken[packet + 12] ^= 1
            with pytest.raises(mpegts.BrokenStream):
                mpegts.demux(bytes(broken))


def test_seekable_format():
    import zstandard

    data = b"".join(seekable.write_file([(3, np.arange(9, dtype="<u4").tobytes()), (None, b""), (8, np.arange(70, dtype="<u4").tobytes())]))
    r = seekable.Reader(io.BytesIO(data), len(data))
    assert r.doc_ids == [3, None, 8] and r.ids(2).tolist() == list(range(70)) and r.ids(1).tolist() == []
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.startswith(np.arange(9, dtype="<u2").tobytes())
    broken = bytearray(data)
    broken[int(r.starts[2]) + 12] ^= 1
    with pytest.raises((seekable.Damaged, zstandard.ZstdError)):
        seekable.Reader(io.BytesIO(bytes(broken)), len(broken)).ids(2)
    with pytest.raises(seekable.Damaged):
        seekable.Reader(io.BytesIO(data[:-3]), len(data) - 3)


def test_byte_bpe(docs, rows, empty, monkeypatch):
    import public_tokenizers
    import tiktoken

    name = "byte_bpe_multi_50k.tiktoken"
    with open(common.tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = tool.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(utf8(t)).hexdigest())] += 1
    monkeypatch.setattr(bytebpe, "BLOCK_TOKENS", 200)
    assert pairs(bytebpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bytebpe.digests(empty).count() == 0
    back = bytebpe.decode(bytebpe.encode(docs)).collect()
    assert Counter((r.doc_id, bytes(r.data)) for r in back) == Counter((i, utf8(t)) for i, t in rows)


def test_byte_bpe_cuts_and_matches_distinct_words_only(monkeypatch):
    """Cutting every text by expressions, and matching the pattern in every block, cost more than the encoding. Texts whose
    pieces are known reach no expression; punctuation stays with its word until words of all blocks have met."""
    looked, pattern = [], bytebpe.tools("byte_bpe_multi_50k.tiktoken")[2]

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def findall(self, x):
            looked.append(x)
            return self.inner.findall(x)

        def search(self, x):
            looked.append(x)
            return self.inner.search(x)

    for name in [k for k, v in vars(bytebpe).items() if hasattr(v, "findall")]:
        monkeypatch.setattr(bytebpe, name, Spy(getattr(bytebpe, name)))
    block = bytebpe.Block(Spy(pattern), only_words=False)
    for k in range(50):
        block.add(k, "Well, it's here.\nNow, it's" + " here, now" * 20)
    assert sum(map(len, looked)) < 200
    assert sorted(block.words) == ["\n", " here,", " here.", " it's", " now", "Now,", "Well,"]
    assert {len(s) for s in block.sequences} == {4 * 46}


def test_byte_bpe_words_beside_white_space():
    """Words found by piece are those that the expression finds in the text, in both scans, and encode as the text does."""
    import public_tokenizers
    import tiktoken

    encode, spoken, pattern = bytebpe.tools("byte_bpe_multi_50k.tiktoken")
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: k for k, b in spoken.items()}, special_tokens={})
    rng = random.Random(8)
    signs = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u200b", "a", "B", "é", "中", "1", "²", "'s", "'", ",", "!?", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(rng.choices(signs[8:], k=rng.randint(20, 90))) + rng.choice(signs) + "".join(rng.choices(signs[-12:], k=rng.randint(20, 90))) for _ in range(500)] + ["", None, " ", "  ", "a ", " a", "\n a", "a \nb"]
    full, words = (bytebpe.Block(pattern, only_words=x) for x in (False, True))
    for k, t in enumerate(texts):
        full.add(k, t)
        words.add(k, t)
    assert list(full.words.items()) == list(words.words.items()) and full.size == words.size
    names = list(full.words)
    for t, s in zip(texts, full.sequences, strict=True):
        got = [names[k] for k in np.frombuffer(s, "<u4")]
        coarse = bytebpe._COARSE.findall(t or "")
        assert "".join(got) == "".join(coarse) and (got == coarse or max(map(len, coarse)) > bytebpe.LONG)
        assert all(len(w) <= bytebpe.LONG or w.isspace() or pattern.findall(w) == [w] for w in got)
        assert [i for w in got for i in encode(w)] == tool.encode_ordinary(t or "")
    assert b"".join(map(spoken.get, encode(" " * 3_000_000))) == b" " * 3_000_000


# 6 and 9: near duplicates


def fingerprint(t):
    w = utf8(t).translate(simhash._LOWER).split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = [fingerprint(t) for _, t in rows]
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    linked = [(a, b) for a in known for b in known if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = roots(len(rows), linked)
    least = {}
    for k in known:
        least[root[k]] = min(least.get(root[k], 10**9), rows[k][0])
    want = Counter((i, fps[k], least[root[k]] if i is not None else None) for k, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id is null").count() == 2


def test_vantage_points(spark, monkeypatch):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(300):
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    monkeypatch.setattr(simhash, "SHARD", 40)
    monkeypatch.setattr(simhash, "LEAF", 5)
    nodes = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)], "node long, fp long")
    stars = [(r.a, r.b) for r in simhash.linked(nodes).collect()]
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert roots(len(fps), stars) == want
    got = {r.node: r.root for r in components.components(simhash.linked(nodes)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    want = roots(300, edges)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert [got.get(k, k) for k in range(300)] == want
    assert components.components(df.filter("false")).count() == 0


def test_passages(docs, empty, spark):
    got = {r.doc_id: r.class_id for r in passages.classes(docs).collect()}
    assert got[4] == got[5] == 4 and got[1] == got[2] == got[3] == got[19] == 1
    assert not {6, 7, 8, 9, 10, 17} & set(got)
    assert passages.classes(empty).count() == 0
    rng = random.Random(8)
    own = [prose(rng, 120).split() for _ in range(12)]
    near = list(own[0][20:90])
    near[35] = "changed"
    far = list(own[1][20:90])
    for k in range(0, 70, 7):
        far[k] = "changed"
    texts = [" ".join(w) for w in own] + [" ".join(own[2][:30] + near + own[3][:30]), " ".join(own[4][:10] + far)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.first_word) for r in passages.classes(df).collect()}
    assert got[0][0] == got[12][0] == 0 and 13 not in got and 1 not in got
    assert 20 <= got[0][1] <= 85 and 30 <= got[12][1] <= 95


def alike(texts, longer=0):
    """Brute force: pairs of texts with passages of 46 (or up to so many more) five-word shingles that share 80 % (Jaccard)."""
    spans, held = [], {}
    for k, t in enumerate(texts):
        w = t.lower().split()
        x = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        spans.append([frozenset(x[k : k + n]) for n in range(46, 47 + longer) for k in range(len(x) - n + 1)])
        for y in set(x):
            held.setdefault(y, []).append(k)
    shared = Counter(p for own in held.values() for p in ((a, b) for b in own for a in own if a < b))
    least = {k: min((len(p) for p in own), default=0) for k, own in enumerate(spans)}
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * max(least[a], least[b])]
    return {(a, b) for a, b in near if any(len(p & q) >= 0.8 * len(p | q) for p in spans[a] for q in spans[b])}


def linked(df):
    return {(r.a, r.b) for r in passages.links(df).collect()}


def test_passages_of_families(spark):
    rng = random.Random(5)
    base, phrase = prose(rng, 54).split(), prose(rng, 12)
    texts = []
    for k in range(300):
        own = list(base)
        for at in rng.sample(range(54), 2):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join(own))
    texts += [prose(rng, 40) + " " + phrase + " " + prose(rng, 40) for _ in range(100)]
    texts += [texts[0] + " end", "start " + texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sure, want = alike(texts), alike(texts, 6)
    found = linked(df)
    assert len(sure) > 200 and found <= want and len(found & sure) >= 0.98 * len(sure)
    got = {r.doc_id: r.class_id for r in passages.classes(df).collect()}
    root = roots(len(texts), found)
    assert got == {k: root[k] for p in found for k in p} and not any(k in got for k in range(300, 400))


def test_passages_with_insertions(spark):
    """A passage of 80 words and its copy with 1 to 10 words put into its middle share 80 % or more."""
    rng, texts = random.Random(9), []
    for k in range(250):
        p = prose(rng, 80).split()
        q = p[:40] + [f"new{k}w{j}" for j in range(k // 25 + 1)] + p[40:]
        texts += [f"{prose(rng, 60)} {' '.join(p)} {prose(rng, 50)}", f"{prose(rng, 45)} {' '.join(q)} {prose(rng, 70)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in passages.classes(df).collect()}
    hits = [[got.get(2 * k) == got.get(2 * k + 1) == 2 * k for k in range(25 * n, 25 * n + 25)] for n in range(10)]
    assert all(sum(h) >= 22 for h in hits) and sum(map(sum, hits)) >= 240
    assert all(got[k] in (k, k - 1) for k in got)


def test_passages_of_documents(spark):
    """The whole small table against all pairs: every pair that shares a passage is in one class, and no other document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in docs:
        w = r.text.lower().split()
        x = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        sets[r.doc_id] = [x[k : k + 46] for k in range(len(x) - 45)]
    held = {}
    for i, spans in sets.items():
        for x in {y for s in spans for y in s}:
            held.setdefault(x, set()).add(i)
    near = Counter(p for own in held.values() for p in ((a, b) for a in own for b in own if a < b))
    pairs = [(a, b) for (a, b), n in near.items() if n >= 41 and any(len(set(p) & q) >= 0.8 * len(set(p) | q) for q in map(set, sets[b]) for p in sets[a])]
    got = {r.doc_id: r for r in passages.classes(spark.createDataFrame(docs)).collect()}
    assert len(pairs) > 10 and sum(a in got and b in got and got[a].class_id == got[b].class_id for a, b in pairs) >= 0.98 * len(pairs)
    assert all(r.first_word >= 0 for r in got.values())
    assert len(set(got) - {x for p in pairs for x in p}) <= 0.05 * len(got)


def test_passages_are_all_told(spark):
    rng = random.Random(6)
    p, q = prose(rng, 80), prose(rng, 60)
    a = f"{prose(rng, 7)} {p} {prose(rng, 50)} {q} {prose(rng, 20)}"
    b = f"{prose(rng, 30)} {q} {prose(rng, 33)} {p}"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {(r.a_word, r.b_word): (r.length, r.shared) for r in passages.links(df).collect()}
    # Shingles beyond what is equal may belong to a passage while 80 % are shared.
    assert all(any(abs(i - x) <= 20 and abs(j - y) <= 20 and n >= least for (i, j), (n, _) in got.items()) for x, y, least in ((2, 118, 76), (132, 25, 56)))
    first = {r.doc_id: r.first_word for r in passages.classes(df).collect()}
    assert 2 <= first[1] <= 77 and 25 <= first[2] <= 81


def test_passages_of_swapped_sentences(spark):
    rng = random.Random(7)
    texts = []
    for k in range(20):
        one, two = ([f"w{rng.randrange(10**6)}" for _ in range(25)] for _ in range(2))
        texts += [" ".join(one + two), " ".join(two + one)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert linked(df) == alike(texts) == {(k, k + 1) for k in range(0, 40, 2)}


def test_registered_queries(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_sql_of_queries(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        got = con.execute(sql)
        at = [[c[0] for c in got.description].index(c) for c in df.columns]
        assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in got.fetchall())


def test_passages_bounds(spark):
    """What the bounds before a comparison leave out isn't linked, and they leave out most of a family's pairs; equal shingles
    in a row make few windows."""
    rng = random.Random(12)
    base, parts = prose(rng, 170).split(), []
    for k in range(120):
        own = [w if rng.random() > 0.002 * (k % 40) else f"x{rng.random()}" for w in base]
        own[rng.randrange(170) : 0] = [f"y{k}z{j}" for j in range(k % 3)]
        x = passages.shingles([" ".join(own).encode()])[0]
        a, b = 85 - passages.REACH, 85 + passages.REACH + 1
        one = lambda v, kind=np.int64: np.array([v], kind)
        parts.append([one(1), one(0), one(b - a), one(passages.REACH), one(20), one(10), one(k), one(k), one(85), passages._short(x[a:b])])
    c = passages.Classes(parts)
    a, b = np.triu_indices(120, 1)
    kept = set(zip(*(x.tolist() for x in c._likely(a, b)), strict=True))
    sure = {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if passages.stretch(c.text(i), c.text(j))}
    got = c._compare(a, b)
    linked = set(zip(got[0].tolist(), got[1].tolist(), strict=True))
    assert linked <= kept and sure <= kept and 100 < len(kept) < 0.7 * len(a)
    same = passages.shingles([b"the " * 400])
    assert sum(len(w[0]) for w in passages.windows(same)) < 15 * 80


def test_passages_told_once(spark):
    """However many buckets tell of a document, its links are opened once."""
    rng = random.Random(13)
    text = prose(rng, 900)
    df = spark.createDataFrame([(k, text) for k in range(64)], "doc_id long, text string")
    rows = passages.Search(df, "doc_id", "text", False).told().collect()
    assert len(rows) == len({(r.doc_id, r.low) for r in rows}) and {r.doc_id for r in rows} == set(range(64))
