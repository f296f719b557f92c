"""Language identification by compression: a text is compressed once for each language, with a zstandard raw-content
dictionary of that language's text; the language of the smallest result wins, and narrow margins are rejected.

Learning takes a bounded sample: per language at most DICTIONARY_BYTES of dictionary, made of pieces of at most
PIECE_BYTES of the documents with the smallest hashes (an order that does not depend on the layout of the input). Every
language value is learned; many of them share a fixed budget. Every document is predicted over its whole text.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the language that sorts first;
with no learned language everything is `und`. Labels, sources and ids never enter a prediction. One row per input row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import common

#: Bounds of the learned sample; more than HELD_LANGS languages share what that many may take, and are scored in blocks.
DICTIONARY_BYTES, PIECE_BYTES, SAMPLE_DOCS, HELD_LANGS = 192 << 10, 1 << 10, 400, 64
#: A text is compressed in blocks of this size, each with the dictionary anew, so that long texts are judged by the
#: language and not by their own repetitions.
BLOCK_BYTES = 16 << 10
#: Relative difference between the two smallest results below which the pipeline rejects a document.
MIN_MARGIN = 0.002

#: Short matches tell languages apart, so the search is a greedy one for four bytes, over a window that holds the dictionary.
_SETTINGS = zstandard.ZstdCompressionParameters.from_level(3, source_size=BLOCK_BYTES, dict_size=DICTIONARY_BYTES, write_content_size=False, write_checksum=False, window_log=18, hash_log=17, chain_log=17, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3)

UND = "und"
_LETTER, _NOT_LETTERS = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language to dictionary bytes. The frame holds the documents that may be learned from; what reaches the driver
    is a count for each language and at most SAMPLE_DOCS pieces of PIECE_BYTES characters for each of HELD_LANGS languages,
    or as many shared by all languages (one for each at least)."""
    usable = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.col(lang_col).cast("string") != UND))
    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    # A piece may start anywhere in its text, by a hash of the id.
    start = F.pmod(F.xxhash64(name, F.lit("start")), F.greatest(F.length(text) - PIECE_BYTES, F.lit(0)) + 1) + 1
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(name).alias("h"), F.substring(text, start.cast("int"), F.lit(PIECE_BYTES)).alias("piece"))
    counted = rows.groupBy("lang").count().collect()
    if not counted:
        return {}
    part = min(1.0, HELD_LANGS / len(counted))
    docs_each, bytes_each = max(1, int(part * SAMPLE_DOCS)), max(PIECE_BYTES, int(part * DICTIONARY_BYTES))
    # A slice of the hashes that holds four times the sample, then exactly the smallest of each language.
    share = {r["lang"]: min(1.0, 4 * SAMPLE_DOCS / r["count"]) for r in counted}
    bounds = docs.sparkSession.createDataFrame([(k, min(2**63 - 1, int(-(2**63) + v * 2**64))) for k, v in share.items()], "__lang string, bound long")
    order = Window.partitionBy("lang").orderBy("h", "piece")
    near = rows.join(F.broadcast(bounds), F.col("lang") == F.col("__lang")).filter(F.col("h") <= F.col("bound"))
    got = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= docs_each).select("lang", "k", "piece").collect()
    pieces: dict[str, dict[str, None]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["k"])):
        pieces.setdefault(r["lang"], {})[clean(r["piece"])] = None
    return {name: " ".join(reversed(own)).encode()[-bytes_each:] for name, own in pieces.items()}


def clean(text: str) -> str:
    """Lower-case words; digits and signs say nothing about the language."""
    return _NOT_LETTERS.sub(" ", text).lower()


class Scorer:
    """Worker side: one compressor for each language, made once; those of more than HELD_LANGS languages are made for each
    block of languages anew."""

    def __init__(self, model: dict[str, bytes]):
        self.names, self.model = sorted(model), model
        self.tools = self._made(self.names) if len(self.names) <= HELD_LANGS else None

    def _made(self, names: list[str]) -> list:
        tools = []
        for name in names:
            d = zstandard.ZstdCompressionDict(self.model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=_SETTINGS)
            tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=_SETTINGS))
        return tools

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """The compressed size of each text for each language."""
        blocks, out = [[t[k : k + BLOCK_BYTES] for k in range(0, len(t), BLOCK_BYTES)] for t in texts], []
        for k in range(0, len(self.names), HELD_LANGS):
            tools = self.tools or self._made(self.names[k : k + HELD_LANGS])
            out.append(np.array([[sum(len(t.compress(b)) for b in own) for t in tools] for own in blocks], float).reshape(len(texts), len(tools)))
        return np.concatenate(out, axis=1)

    def predict_all(self, rows: list[bytes | None]) -> list[tuple[str, float, float]]:
        """Language, score in 0 to 1 and relative margin of each text."""
        out, at, texts = [(UND, 0.0, 0.0)] * len(rows), [], []
        for k, data in enumerate(rows):
            if data and self.names and _LETTER.search(text := data.decode("utf-8", "replace")):
                at.append(k)
                texts.append(clean(text).encode())
        if not at:
            return out
        for row, sizes in zip(at, self.sizes(texts), strict=True):
            k = int(sizes.argmin())
            if len(sizes) == 1:
                out[row] = self.names[0], 1.0, 1.0
                continue
            second = float(np.partition(sizes, 1)[1])
            margin = (second - sizes[k]) / max(second, 1.0)
            out[row] = self.names[k], float(1 / len(sizes) + (1 - 1 / len(sizes)) * (1 - np.exp(-20 * margin))), float(margin)
        return out

    def predict(self, data: bytes | None) -> tuple[str, float, float]:
        return self.predict_all([data])[0]


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin) for every row. A map: nothing is shuffled; the model (bounded by learn) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in common.parts(batches, 1000):
            got = scorer.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    return common.id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")


def keep_identified(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The rows whose language is clear, with all their columns: `und` and narrow margins go."""
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    at = columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in common.parts(batches, 1000):
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in batch.column(at).to_pylist()]
            keep = [lang != UND and margin >= min_margin for lang, _, margin in scorer.predict_all(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
