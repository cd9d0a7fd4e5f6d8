"""Tables and checkpoints in the folder that a cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: their Python needn't have it on its path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-ship-"), "strandline_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    out.write(whole, os.path.join("strandline", os.path.relpath(whole, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """df computed now and read from the shared folder from then on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def read_lines(path: str) -> list[str]:
    """The lines of a small text file on any file system, also from inside a task; none if it isn't there."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if system.get_file_info(base).type != fs.FileType.File:
        return []
    with system.open_input_stream(base) as f:
        return f.read().decode("utf-8").splitlines()
