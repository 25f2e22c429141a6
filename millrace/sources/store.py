"""Small files in the store that holds the tables, through Hadoop's file systems, so in any that Spark can reach."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def url(self, name: str) -> str:
        """The whole address, as Spark's _metadata.file_path has it."""
        return self._fs.makeQualified(self._path(name)).toUri().toString()

    def names(self, folder: str) -> list[str]:
        """The names in a folder, in order; none if it is not there. Hidden ones are left out."""
        at = self._path(folder)
        found = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(x for x in found if x[0] not in "._")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def age_seconds(self, name: str) -> float:
        now = self._jvm.java.lang.System.currentTimeMillis()
        return (now - self._fs.getFileStatus(self._path(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Stores a file as a whole unless the name is taken; whether it did.

        The text goes to a hidden file first, which is then renamed. A rename that doesn't overwrite is atomic in HDFS and its
        like; a local disk, which is for tests, looks first and then renames.
        """
        draft, at = self._path(f".{uuid.uuid4().hex}"), self._path(name)
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(at.getParent())
        # no options: don't overwrite
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(at), none)
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.toString():
                return False
            raise

    def delete(self, name: str, when_driver_ends: bool = False) -> None:
        self._fs.deleteOnExit(self._path(name)) if when_driver_ends else self._fs.delete(self._path(name), True)
