"""Small files wherever Spark can reach them, through its own file systems."""

from __future__ import annotations

import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError


class Files:
    """The file system of ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        at = self.path(path)
        self.fs = at.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), conf)
        self.once = spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, folder: str) -> list[str]:
        """What is in a folder; nothing if there is none."""
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def put_new(self, path: str, text: str) -> bool:
        """A file under ``path`` with all of ``text``, in one step; False if there is one."""
        hidden = self.path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, False)
        stream.write(text.encode())
        stream.close()
        try:
            self.context.rename(hidden, self.path(path), self.once)
        except (Py4JJavaError, CapturedException) as e:
            self.fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
