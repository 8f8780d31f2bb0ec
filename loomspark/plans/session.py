"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application, unless PYTHONPATH already does; where the session
    has the usual limit of bytes for what they are sent at once, lower it, as a task holds several such batches."""
    if spark.conf.get(BATCH, None) == "67108864b":
        spark.conf.set(BATCH, "4m")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(":"):
            path = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), "loomspark.zip")
            with zipfile.ZipFile(path, "w") as z:
                for p in sorted((ROOT / "loomspark").rglob("*.py")):
                    z.write(p, p.relative_to(ROOT))
            spark.sparkContext.addPyFile(path)
    return spark
