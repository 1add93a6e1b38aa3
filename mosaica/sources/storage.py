"""A folder for what a query writes on its way: shared by all executors, or local where there is one machine only."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path, below ``spark.checkpoint.dir`` if the session has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mosaica-")
    return f"{base.rstrip('/')}/mosaica-{uuid.uuid4().hex}"
