"""Forced writes: whole or not at all."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from glossa.sources import sinks


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).collect())


def rows(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)


def test_a_failed_write_leaves_the_old_text(spark, tmp_path):
    path = tmp_path / "out"
    sinks.write_text(rows(spark, "a", "b"), str(path), "t")
    with pytest.raises(AnalysisException):
        sinks.write_text(rows(spark, "c"), str(path), "t")
    broken = rows(spark, *"cdefgh").withColumn("t", F.when(F.col("t") == "g", F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_text(broken, str(path), "t", force=True)
    assert lines(spark, path) == ["a", "b"]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.write_text(rows(spark, "c"), str(path), "t", force=True)
    assert lines(spark, path) == ["c"] and [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.write_text(rows(spark, "new"), str(tmp_path / "other"), "t", force=True)
    assert lines(spark, tmp_path / "other") == ["new"]


def test_a_rename_that_fails_puts_the_old_text_back(spark, tmp_path):
    path = tmp_path / "out"
    sinks.write_text(rows(spark, "a"), str(path), "t")
    with pytest.raises(Exception, match="staged"):
        sinks.replaced(spark, str(path), lambda to: None)  # nothing was written that could take the place
    assert lines(spark, path) == ["a"] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_dead_writer_is_recovered_from(spark, tmp_path):
    path = tmp_path / "out"
    sinks.write_text(rows(spark, "a"), str(path), "t")
    path.rename(tmp_path / "out.replaced-1")
    sinks.recovered(spark, str(path))
    assert lines(spark, path) == ["a"]
    path.rename(tmp_path / "out.replaced-2")
    sinks.write_text(rows(spark, "b"), str(path), "t", force=True)
    assert lines(spark, path) == ["b"] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_texts_made_from_what_they_replace(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_text(rows(spark, "a", "b"), path, "t")
    sinks.write_text(spark.read.text(path).select(F.upper("value").alias("t")), path, "t", force=True)
    assert lines(spark, path) == ["A", "B"]


def test_states_replace_their_own_papers_only(spark, tmp_path):
    path = str(tmp_path / "states")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    sinks.persist(spark.createDataFrame([("p", 1), ("q", 1)], "paper_id string, n int"), path)
    sinks.persist(spark.createDataFrame([("q", 2)], "paper_id string, n int"), path)
    assert {(r.paper_id, r.n) for r in spark.read.parquet(path).collect()} == {("p", 1), ("q", 2)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
