"""Makes the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the session's workers, once, unless their path has it anyway.

    A job that was submitted with the package (``--py-files``, PYTHONPATH) needs nothing.
    """
    sc = spark.sparkContext
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.master.startswith("local[") or sc.master == "local":
        paths.append(os.getcwd())
    shipped = any(os.path.basename(f) == "loomgraph.zip" for f in getattr(sc, "_python_includes", []))
    if shipped or any(os.path.realpath(p) == str(PACKAGE.parent) for p in paths) or PACKAGE.parent.suffix == ".zip":
        return
    path = os.path.join(tempfile.mkdtemp(), "loomgraph.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
