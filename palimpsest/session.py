"""Sessions with the settings that the engine assumes, and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "palimpsest", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use __ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names; a temporary one only where it names none and runs in one
    process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
