"""Ships this package to executors, so that Python workers find it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the application once, which Spark serves to every executor, and sets batch sizes that nobody has set."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "fieldloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("fieldloom", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        if spark.conf.get(ROWS, None) is None:  # texts can be long: smaller Arrow batches bound a worker's memory
            spark.conf.set(ROWS, "2000")
        _SHIPPED.add(app)
    return spark
