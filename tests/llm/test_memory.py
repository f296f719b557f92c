"""What Python workers hold: Arrow batches of bounded bytes, and memory that is given back."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa import session
from glossa.llm import common

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(spark):
    """Rows and bytes of each batch of 16 MB of text."""

    def measured(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    return [tuple(r) for r in docs.mapInArrow(measured, "rows long, bytes long").collect()]


@pytest.fixture
def unset(spark):
    held = spark.conf.getAll.get(SETTING)
    spark.conf.unset(SETTING)
    yield
    spark.conf.unset(SETTING) if held is None else spark.conf.set(SETTING, held)


def test_batches_are_bounded_by_bytes(spark, unset):
    got = session.shipped(sizes)(spark)
    assert sum(rows for rows, _ in got) == 4000
    assert max(size for _, size in got) < 1.5 * session.BATCH_BYTES


def test_a_setting_of_the_session_stays(spark, unset):
    spark.conf.set(SETTING, str(64 << 20))
    assert [rows for rows, _ in session.shipped(sizes)(spark)] == [4000]


@pytest.mark.skipif(not common._trim(), reason="no malloc_trim")
def test_a_worker_gives_memory_back():
    """Free blocks between used ones stay with the process unless it lets go of them."""
    code = """
import numpy as np
from glossa.llm import common
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
blocks = [np.ones(8000) for _ in range(4000)]
blocks[:] = blocks[::50]
before = held()
list(common.parts([]))
print(before - held())
"""
    root = os.path.dirname(os.path.dirname(session.__file__))
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": root})
    assert int(got.stdout) > 100
