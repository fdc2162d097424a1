"""Sessions: the settings that the dialect needs, and the package on the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings of a session of our own; a given session keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
_shipped: set[str] = set()


def make(master: str = "local[8]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("lodestar")
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def prepare(spark: SparkSession) -> None:
    """Sends the package to the Python workers, unless their PYTHONPATH has it already; once for each application."""
    top = Path(__file__).resolve().parent
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(top.parent) in on_path or app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
