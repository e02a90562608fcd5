"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once for each context, so that Python workers can import it from anywhere."""
    context, root = spark.sparkContext, Path(__file__).parent
    if not getattr(context, "_strandlake_shipped", False):
        path = Path(tempfile.mkdtemp(prefix="strandlake-")) / "strandlake.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(path))
        context._strandlake_shipped = True
    return spark
