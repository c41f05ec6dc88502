"""Numbered versions of a table: small JSON files that say which folders are in force.

A version is published by creating its file, which the file system does for one writer only (HDFS and stores with conditional puts; a
local file system for writers that do not race within the same instant). Data folders have names of their own, so an unfinished or refused write leaves
nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_versions"


class Taken(RuntimeError):
    """Another writer published this version first: read the newest one and begin anew."""


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """The entries of a folder; none if there is no folder."""
    fs, p = file_system(spark, folder)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def listed(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, f"{root}/{FOLDER}") if n.endswith(".json"))


def read(spark: SparkSession, root: str, version: int) -> dict:
    fs, p = file_system(spark, f"{root}/{FOLDER}/{version}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> int | None:
    """The newest version whose file is whole: one that is being written this instant is not there yet."""
    for v in reversed(listed(spark, root)):
        try:
            read(spark, root, v)
        except json.JSONDecodeError:
            continue
        return v
    return None


def publish(spark: SparkSession, root: str, version: int, body: dict) -> int:
    fs, p = file_system(spark, f"{root}/{FOLDER}/{version}.json")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise Taken(f"version {version} of {root} is taken") from e
        raise
    try:
        out.write(bytearray(json.dumps(body).encode()))
    finally:
        out.close()
    return version


def fresh_name(version: int) -> str:
    return f"v={version}-{uuid.uuid4().hex[:8]}"
