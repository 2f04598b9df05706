"""One place for what path means which file system, for all sources and on driver and executors alike."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Spark's names of object stores, and those that Arrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

#: File systems whose paths do not hold the host.
NAMED_HOSTS = {"hdfs", "viewfs"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system; one without a scheme belongs to the session's default file system.

    Called on the driver, which knows the session; tasks get the result.
    """
    if "://" in path or path.startswith("file:"):
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, as the driver's file system lists them: no file is opened and no query fails."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().toString() for f in found] if found is not None else []


def exists(spark: SparkSession, pattern: str) -> bool:
    return bool(matching(spark, pattern))


def filesystem(path: str):
    """(Arrow file system, path in it)."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        scheme, rest = path.split("://", 1)
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    local = path[5:] if path.startswith("file:") else path
    return fs.LocalFileSystem(), os.path.abspath("/" + local.lstrip("/") if path.startswith("file:") else local)


def prefix(root: str) -> str:
    """What stands in front of a path of the root's file system to make it a path again.

    Arrow's paths of object stores begin with the bucket, those of HDFS leave the name node out.
    """
    if "://" not in root or root.startswith("file:"):
        return ""
    scheme, rest = root.split("://", 1)
    return f"{scheme}://{rest.split('/', 1)[0]}" if scheme in NAMED_HOSTS else f"{scheme}://"
