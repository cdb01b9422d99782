"""Folders that the driver and all executors share."""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine keeps files if it names no folder.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only on one machine, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_FALLBACK
    return found.rstrip("/")


def place_of(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    place, fs = place_of(spark, path)
    fs.deleteOnExit(place)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: computed once, and safe from the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    place, fs = place_of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    place, fs = place_of(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def published(spark: SparkSession, path: str, body: str) -> bool:
    """Makes a small file of this text, unless there is one: then False, and nothing is changed. Of several writers one
    alone gets True, and nobody sees a part of the text.

    The text is written beside and then linked or renamed to its name, which fails where the name is taken. That is one
    step on POSIX file systems (link) and on HDFS (rename without overwriting). Object stores rename by copying: there
    two writers can both get True, unless the connector refuses to replace what exists, so keep to one writer at a time.
    """
    place, fs = place_of(spark, path)
    folder = place.getParent()
    fs.mkdirs(folder)
    beside = spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(beside.toUri().getPath(), place.toUri().getPath())
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            context.rename(beside, place, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if fs.exists(place):
            return False
        raise e
    finally:
        fs.delete(beside, False)


class Manifests:
    """Numbered JSON files of a folder, each number taken once. The last one tells what is committed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:09}.json"

    def numbers(self) -> list[int]:
        return sorted(int(n[:9]) for n in listed(self.spark, self.folder) if re.fullmatch(r"\d{9}[.]json", n))

    def read(self, number: int) -> dict:
        return json.loads(read_small(self.spark, self._path(number)))

    def last(self) -> tuple[int, dict]:
        """The last number and what it says; (0, {}) before the first."""
        number = max(self.numbers(), default=0)
        return number, self.read(number) if number else {}

    def put(self, number: int, body: dict) -> bool:
        """False if another writer took the number."""
        return published(self.spark, self._path(number), json.dumps(body))

    def forget(self, keep: int) -> None:
        for number in self.numbers()[:-keep]:
            removed(self.spark, self._path(number))


def removed(spark: SparkSession, path: str) -> None:
    place, fs = place_of(spark, path)
    fs.delete(place, True)


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was changed."""
    place, fs = place_of(spark, path)
    return time.time() - fs.getFileStatus(place).getModificationTime() / 1000
