"""Sessions, this package's code on the executors, and the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_made: dict[str, None] = {}


def session(name: str = "recordloom", **conf: str) -> SparkSession:
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}
    return ship(SparkSession.builder.appName(name).config(map=settings).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, unless their PYTHONPATH has it already.

    Functions that run in Python workers are pickled by reference, so the workers
    must be able to import their modules.
    """
    app = spark.sparkContext.applicationId
    there = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if str(_ROOT) not in there and app not in _shipped:
        folder = tempfile.mkdtemp(prefix="recordloom-code-")  # executors fetch the file from the driver when they start
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/recordloom-code", "zip", _ROOT, "recordloom"))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (a local session, as in tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, what: str) -> str:
    """A path for one written table or file set, below the shared folder; deleted by ``release`` or when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_release_at_exit, spark)
    _made[path] = None
    return path


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``new_folder`` gave; nothing that is still to be computed may read them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        _made.pop(path, None)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def made_folders() -> list[str]:
    """The folders given so far and not released, oldest first."""
    return list(_made)


def _release_at_exit(spark: SparkSession) -> None:
    """What is left goes; a cluster that is gone already keeps its files."""
    with contextlib.suppress(Exception):
        release(spark, made_folders())
