"""Python workers find this package wherever the driver was started."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def python_workers(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path. It helps on the driver's machine; on a cluster the package is
    installed or sent with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
