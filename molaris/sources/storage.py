"""Folders for written tables: where they go, which exist, dropping old ones."""

from __future__ import annotations

import re
import uuid
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Did the job that wrote this table finish?"""
    marker, system = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(marker)


def hidden_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[tuple[str, int, int]]:
    """(path, size, change time) of the files of a folder that Spark's readers skip: names that begin with ``_`` or ``.``.

    Marks that jobs leave behind (``_SUCCESS``, checksums) are no data.
    """
    out = []
    for start in ("_", "."):
        path, system = _file_system(spark, f"{folder.rstrip('/')}/{start}*")
        for status in system.globStatus(path) or []:
            name = status.getPath().getName()
            data = not (name == "_SUCCESS" or name.endswith(".crc") or name.startswith(("_started_", "_committed_")))
            if status.isFile() and data and fnmatchcase(name, pattern):
                out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def folders_named(spark: SparkSession, root: str, name: str) -> list[str]:
    """Names below ``root`` that match a regular expression as a whole, oldest first."""
    path, system = _file_system(spark, root)
    if not system.exists(path):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(path) if s.isDirectory()]
    return [n for _, n in sorted(found) if re.fullmatch(name, n)]


def drop_folder(spark: SparkSession, path: str) -> None:
    target, system = _file_system(spark, path)
    system.delete(target, True)
