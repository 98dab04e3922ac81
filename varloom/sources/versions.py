"""The versions of a store: small files under `path`/log, of which the one with the highest number counts.

A version names the parts that are live and from which block on each is replaced by later ones.  Tables of a part are
written first; the version's file then takes its number by one rename that fails if another writer was first.  What no
version names is invisible: the parts of failed attempts, and those that a version has replaced.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    place, fs = _place(spark, f"{path}/log")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, path: str) -> dict | None:
    """The live version, with its number; None if there is no store."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    place, fs = _place(spark, f"{path}/log/{numbers[-1]:08d}.json")
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: dict) -> None:
    """Make a version, whose number is one above the live one, the live one; raises if that number is taken."""
    target, fs = _place(spark, f"{path}/log/{version['number']:08d}.json")
    source, _ = _place(spark, f"{path}/log/_{uuid.uuid4().hex}")
    out = fs.create(source, False)
    out.write(json.dumps(version).encode())
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(source, False)
        raise ValueError(f"version {version['number']} of {path} was written by another") from e


def clear(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, f"{path}/log")
    fs.delete(place, True)


def new_part() -> int:
    """A number that no attempt has used."""
    return uuid.uuid4().int & 0x7FFFFFFF


def live(version: dict) -> Column:
    """The condition on part and block_id of what a version holds; parts are folders, so others are not opened."""
    parts = version["parts"]
    found = F.col("part").isin([p for p, _ in parts])
    for part, end in parts:
        if end is not None:
            found = found & ((F.col("part") != part) | (F.col("block_id") < end))
    return found
