"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir.  Where that is unset, a local session gets a local one; any other is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/sparkfold-shared"
    return f"{base.rstrip('/')}/sparkfold-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> str:
    """Sends this package to the workers of a session whose nodes don't have it installed; the name of the archive."""
    folder, name = tempfile.mkdtemp(), "sparkfold-package.zip"
    if not any(f.endswith(name) for f in spark.sparkContext.listFiles):
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(f"{folder}/{name}", "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(f"{folder}/{name}")
    return name
