"""Session helpers: a local builder for tests and benches, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries assume: UTC and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voxledger")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, as --py-files would; once for a context."""
    sc = spark.sparkContext
    if getattr(sc, "_voxledger_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="vox-ship-"), "voxledger.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._voxledger_shipped = True
