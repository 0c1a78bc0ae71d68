"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tracefold_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tracefold-"), "tracefold_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tracefold", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._tracefold_shipped = True
    return spark


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a local one only where one machine is all there is."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = os.path.join(tempfile.gettempdir(), "tracefold-work")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
