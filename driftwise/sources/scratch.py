"""A folder for files that a job writes and reads again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[SparkSession, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a local session may go without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark not in _OWN:
            own = tempfile.mkdtemp(prefix="driftwise-files-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN[spark] = "file://" + own
        found = _OWN[spark]
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"
