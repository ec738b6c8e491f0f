"""Make the package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, set where Spark's default stands.
ARROW_BYTES, ARROW_DEFAULT = str(4 << 20), "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context.

    Functions of the package are pickled by name, so workers must be able to
    import it wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    # rows of long texts make small Arrow batches, whatever their number
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == ARROW_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    top = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="textloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    atexit.register(lambda: Path(name).unlink(missing_ok=True))
    sc._textloom_shipped = True
