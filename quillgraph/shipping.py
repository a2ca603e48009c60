"""Make this package importable on executors that do not share the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a Spark application."""
    app = spark.sparkContext.applicationId
    if getattr(ship, "app", None) == app:
        return
    target = Path(tempfile.mkdtemp(prefix="quillgraph-")) / "quillgraph_sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    ship.app = app
