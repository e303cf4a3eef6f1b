"""Making the package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from chainloom.sources.checkpoints import shared_folder

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application.

    The driver serves the archive to the executors.  It lies next to the
    checkpoints where those are in a mounted folder, else in a folder of the
    driver, which holds code only.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = shared_folder(spark)
    local = folder.removeprefix("file://") if folder.startswith(("file:", "/")) else tempfile.mkdtemp(prefix="chainloom-")
    os.makedirs(local, exist_ok=True)
    archive = os.path.join(local, f"chainloom-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for base, folders, files in os.walk(package):
            folders[:] = sorted(f for f in folders if f != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
