"""Text-pair analytics on Spark: features, graph and frequency signals, assembly, models and ensembles."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: by path where they share the driver's machine, else as an archive."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.master.startswith("local"):
        paths = [here, *filter(None, (sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep))]
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    else:
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "pairloom"), "zip", here, "pairloom")
        sc.addPyFile(archive)
