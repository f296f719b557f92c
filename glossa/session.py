"""Makes this package importable on executors, whatever folder the driver was started in."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Bytes of rows that Spark sends to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by their bytes: 10,000 rows (Spark's bound) of whole texts are tens of MB, of which the JVM's
    direct memory and each worker keep several copies, and don't give them back. All rows are sent, in more batches."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once per context (some hundred KB)."""
    context = spark.sparkContext
    if getattr(context, "_glossa_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="glossa-"), "glossa.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("glossa", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._glossa_shipped = True


def shared_base(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir, which driver and executors share. Without that setting a
    folder of this machine is used, which only a local session may do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_glossa_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark._glossa_shared = "file://" + tempfile.mkdtemp(prefix="glossa-shared-")
    # A full address, so that executors don't depend on their default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    base = re.sub("^file:/(?!/)", "file:///", base)
    return f"{base.rstrip('/')}/glossa-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def shipped(f: Callable) -> Callable:
    """f, whose first argument is a session, with the package shipped and batches bounded first."""

    @functools.wraps(f)
    def run(spark, *args, **kwargs):
        ship(spark)
        bounded(spark)
        return f(spark, *args, **kwargs)

    return run
