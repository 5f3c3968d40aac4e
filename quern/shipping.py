"""What driver and executors share: this package's sources, and a folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern-sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    context.addPyFile(str(target))
    _done.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/quern-{what}-{uuid.uuid4().hex}"
