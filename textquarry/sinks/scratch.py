"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; under a temporary folder where that is unset and Spark runs in one process (tests). On a cluster without
    the setting it is an error, as a folder of one machine would lose data."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
