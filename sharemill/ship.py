"""Sends this package to the executors of a session that can't import it."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def archive(to: str) -> str:
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(HERE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(HERE)))
    return to


def ready(spark: SparkSession) -> None:
    """Once a session. Where the package lies on PYTHONPATH, executors find it as the driver does;
    otherwise it goes along as a file that Spark distributes."""
    context = spark.sparkContext
    home = os.path.dirname(HERE)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in known or getattr(context, "_sharemill_shipped", False):
        return
    context.addPyFile(archive(os.path.join(tempfile.mkdtemp(prefix="sharemill-"), "sharemill.zip")))
    if sys.path and sys.path[0] != home:
        sys.path.insert(0, home)  # the driver keeps its own copy
    context._sharemill_shipped = True
