"""Small file operations over Hadoop's FileSystem, so that every store Spark reads works; none of them starts a job."""

from __future__ import annotations

import posixpath
import tempfile
from typing import Any

from pyspark import SparkContext
from pyspark.sql import SparkSession

from stepwell.settings import located


def active() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


#: For the running context: Hadoop's Path class, the configuration, and the file system of each store. Each question to the
#: JVM is a round trip, and a graph of tasks asks for very many files.
_known: dict[str, Any] = {}


def _handle(path: str) -> tuple[Any, Any]:
    sc = SparkContext._active_spark_context or active().sparkContext
    if _known.get("of") is not sc:
        _known.clear()
        _known.update(of=sc, Path=sc._jvm.org.apache.hadoop.fs.Path, conf=sc._jsc.hadoopConfiguration())
    where = located(path)
    p = _known["Path"](where)
    store = "/".join(where.split("/", 3)[:3]) if "://" in where else ""
    if store not in _known:
        _known[store] = p.getFileSystem(_known["conf"])
    return _known[store], p


def cut(df: Any) -> Any:
    """Checkpoint a frame in the folder that driver and executors share: spark.checkpoint.dir, which has to be set but where
    all is one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stepwell-"))
    return df.checkpoint(eager=True)


def exists(path: str) -> bool:
    fs, p = _handle(path)
    return fs.exists(p)


def delete(path: str) -> bool:
    fs, p = _handle(path)
    return fs.delete(p, True)


def rename(old: str, new: str) -> None:
    """Move a file or directory, replacing what is there."""
    fs, a = _handle(old)
    _, b = _handle(new)
    fs.mkdirs(b.getParent())
    if fs.exists(b):
        fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"could not move {old} to {new}")


def names(path: str) -> list[str]:
    """Names in a directory, sorted; none where it doesn't exist."""
    fs, p = _handle(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def modified(path: str) -> float:
    """Seconds since the epoch at which a file or directory was last changed."""
    fs, p = _handle(path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def read_bytes(path: str) -> bytes:
    fs, p = _handle(path)
    stream = fs.open(p)
    try:
        return bytes(active()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put_bytes(path: str, data: bytes) -> None:
    """Write a file in a folder that nobody reads yet."""
    fs, p = _handle(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_bytes(path: str, data: bytes) -> None:
    """Write beside the path, then move into place: a reader sees the old or the new content."""
    beside = posixpath.join(posixpath.dirname(path), f"_tmp.{posixpath.basename(path)}")
    put_bytes(beside, data)
    rename(beside, path)
