"""Sessions: starting one for tests and benches, and sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT = "_quillgrid_sent"
#: Bytes and rows of an Arrow batch on its way to Python: long texts would fill workers with Spark's 64 MB. Set where the session has Spark's defaults.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000")}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once for each Spark application, and keep Arrow batches small."""
    for name, (default, ours) in ARROW.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    context = spark.sparkContext
    if getattr(context, _SENT, None) != context.applicationId:
        top = Path(__file__).resolve().parent
        name = os.path.join(tempfile.mkdtemp(prefix="quillgrid-"), "quillgrid.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        context.addPyFile(name)
        setattr(context, _SENT, context.applicationId)
    return spark


def local(cpus: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow, as tests and bench.py use it."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return ship(SparkSession.builder.master(f"local[{cpus}]").appName("quillgrid").config(map=settings).getOrCreate())
