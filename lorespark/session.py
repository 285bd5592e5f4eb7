"""Sessions: settings for running on one machine, and the package on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "lorespark") -> SparkSession:
    """A session on this machine, in UTC, with as many shuffle partitions as cores."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {"spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    if cores != "*":
        conf["spark.sql.shuffle.partitions"] = str(cores)
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application.

    Executors then need no copy of the repository on their own path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lorespark-")) / "lorespark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
