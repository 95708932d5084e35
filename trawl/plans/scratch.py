"""Where queries that store tables may do so: a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a temporary one if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="trawl-scratch-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        found = _OWN[app]
    return f"{found.rstrip('/')}/trawl-scratch/{tag}-{uuid.uuid4().hex}"
