"""Making this package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Rows of a batch between Spark and Python, unless the session says otherwise: whole texts make batches large.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application: functions that run on executors import it."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="cairn-")) / "cairn.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
