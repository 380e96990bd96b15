"""A place for files that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode under a folder of this machine where
    that is unset. A cluster must name a folder that its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="quadro-scratch-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
