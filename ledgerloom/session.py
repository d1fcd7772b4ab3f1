"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Only steps that run Python on executors need it.  Where the package is installed on every
    node this is not needed; Spark distributes the archive itself.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ledgerloom-ship-")) / package.name
        spark.sparkContext.addPyFile(
            shutil.make_archive(str(archive), "zip", root_dir=package.parent, base_dir=package.name)
        )
        _shipped.add(application)


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor reaches: ``spark.checkpoint.dir``.

    Only a local session, whose executors are this process, gets a folder of its own where none is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.startswith("local"):
        if not spark.sparkContext.master.startswith("local-cluster"):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
            root = spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return root.rstrip("/")
