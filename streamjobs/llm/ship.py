"""Makes the library importable in Python workers that were started without it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of the Arrow batches in which rows go to Python: whole texts are large rows.
BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the workers, once per application, as ``--py-files`` would.

    Also sets the session's Arrow batches to at most about ``BATCH`` bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="sources-")) / f"{package.name}.zip"  # the driver sends it on from here
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
