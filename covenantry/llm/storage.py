"""The shared folder: where operators put what must outlive a lost executor.

A cluster names the folder in ``spark.checkpoint.dir``; every executor and the driver see it.
Only where that setting is absent and the master is local (tests, a laptop) is a temporary folder chosen;
on a cluster its absence is an error, since a folder of one machine is lost with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder (as a URI) for one run of an operator, below the session's shared folder."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _fallback.setdefault(app, "file://" + tempfile.mkdtemp(prefix="covenantry-"))
    return f"{base.rstrip('/')}/covenantry/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut there.

    The size of what is read back is known, so Spark broadcasts it only if it is below
    ``spark.sql.autoBroadcastJoinThreshold``."""
    return store(df, purpose)[0]


def store(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As ``materialise``, and the folder, for callers that ``discard`` what no later job reads."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(path: str) -> None:
    """Remove a stored folder."""
    system, name = open_filesystem(path)
    system.delete_dir(name)


def open_filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs...) and the path within it; for use in tasks."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class SharedFile:
    """A new file under a name of its own: a repeated task attempt writes another, and the manifest names one."""

    def __init__(self, folder: str, name: str):
        system, path = open_filesystem(folder)
        system.create_dir(path, recursive=True)
        stem, _, suffix = name.partition(".")
        own = f"{stem}-{uuid.uuid4().hex[:12]}.{suffix}"
        self.uri, self.size = f"{folder}/{own}", 0
        self._out = system.open_output_stream(f"{path}/{own}", compression=None, buffer_size=1 << 20)

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which ``data`` begins."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._out.close()
