"""Session settings, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build_session(master: str = "local[8]", **settings) -> SparkSession:
    """A session with the settings the engine is tuned for; any of them can be overridden."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): str(v) for k, v in settings.items()}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="plumbline-code-"), "plumbline_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
