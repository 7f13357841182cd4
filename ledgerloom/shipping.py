"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Send the package to the workers, once per context, unless their path has it already.

    The archive is read by the driver alone, which serves it to the executors.
    """
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_ledgerloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / f"ledgerloom-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "ledgerloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(path))
    sc._ledgerloom_shipped = True
