"""Small files and folders through Hadoop's FileSystem, so tables can live wherever Spark can read."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str) -> str:
        return "/".join([self.path, *names])

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def make(self) -> None:
        self.fs.mkdirs(self._path(self.path))

    def names(self, prefix: str = "", under: str = "") -> list[str]:
        at = self._path(self.at(under) if under else self.path)
        if not self.fs.exists(at):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(n for n in found if n.startswith(prefix))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> None:
        """All or nothing: a temporary file of its own, then one rename, which replaces what is there, or with ``new`` fails if something is."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        temp, final = self._path(self.at(f".{uuid.uuid4().hex}.tmp")), self._path(self.at(name))
        out = self.fs.create(temp, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE if new else rename.OVERWRITE
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            files.rename(self.fs.makeQualified(temp), self.fs.makeQualified(final), how)
        except Py4JJavaError as e:
            self.fs.delete(temp, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise FileExistsError(self.at(name)) from None
            raise

    def claim(self, name: str, text: str) -> None:
        """A file that only one can make: the file system decides who. Fails if it is there."""
        try:
            out = self.fs.create(self._path(self.at(name)), False)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getSimpleName() or self.exists(name):
                raise FileExistsError(self.at(name)) from None
            raise
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def log(self, name: str):
        """A stream whose ``hsync`` returns when what was written is stored. A local file system keeps checksums by block, so its plain form is used."""
        fs = self.fs.getRaw() if hasattr(self.fs, "getRaw") and self.fs.getUri().getScheme() == "file" else self.fs
        return fs.create(self._path(self.at(name)), True)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)
