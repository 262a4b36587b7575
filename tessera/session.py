"""Getting this package to the Python workers of a session, and the folder they share."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch to and from Python, where the session leaves the default: texts can be long.
ARROW_ROWS = "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Give the session's executors the package's source, once for each application.

    ``addPyFile`` serves it from the driver, so executors need no install of their own.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        path = Path(tempfile.mkdtemp(prefix="tessera-src-")) / "tessera_src.zip"
        path.write_bytes(data.getvalue())
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one ``spark.checkpoint.dir`` names.

    Where that is unset, a temporary folder of this machine, for a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def local_session(cpus: str = "*") -> SparkSession:
    """The active session, or a local one for the command lines."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
