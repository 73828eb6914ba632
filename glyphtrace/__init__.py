"""A PySpark engine for auditing text and files, and for preparing text corpora."""

from __future__ import annotations

import os


def reach(spark) -> None:
    """Let Python workers that share this file system import the package from where it is installed."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    had = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in had.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, had]))
