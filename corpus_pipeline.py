"""The corpus pipeline: documents pass five stages, each written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import common, langid, neardup, packing, suffixdedup, toxicity
from glossa.session import shipped


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly. Null texts and those without a letter go, as do narrow margins;
    rows without id or language are judged like any other, but nothing is learned from them; repeated rows fare alike."""
    return langid.keep_identified(docs, langid.learn(docs.filter(~langid.held_out())))


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject. Null and empty texts are scored as texts without evidence, so they stay
    unless most labelled documents are toxic; repeated rows fare alike; without labels of both classes all get one score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, toxicity.learn(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares 80 % of its five-word shingles: SimHash fingerprints through
    vantage-point trees, and bands of smallest hashes for pairs beyond their radius, compared exactly. Rows without id stay,
    rows that repeat an id are judged each by its own text, null and wordless texts are alike."""
    return neardup.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what was said before (in documents of smaller doc_id, then in rows without id), to the byte. Null texts
    stay null; a text that is wholly repeated stays as an empty one; rows that repeat an id count in the order of their texts."""
    return suffixdedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: every id of every row in one piece exactly; null texts are the end id alone, repeated rows are all
    packed."""
    return packing.pack(docs)


STAGES = [(name, shipped(f)) for name, f in (("language_id", language_id), ("toxicity", ordinary), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack))]

#: Compression, language models, tokenizers and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
