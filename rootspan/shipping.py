"""Makes this package importable on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_one = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each application."""
    with _one:
        app = spark.sparkContext.applicationId
        if app in _shipped:
            return
        here = Path(__file__).parent
        to = os.path.join(tempfile.mkdtemp(prefix="rootspan-"), "rootspan.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(here.rglob("*.py")):
                z.write(path, path.relative_to(here.parent))
        spark.sparkContext.addPyFile(to)
        _shipped.add(app)
