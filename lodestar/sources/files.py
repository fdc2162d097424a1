"""Small files on any file system that Spark's Hadoop client reaches."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.uri(name))

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def parquet(self, folder: str) -> list[str]:
        """Names, relative to the root, of the data files below a folder."""
        out, found = [], self._fs.listFiles(self._path(folder), True)
        top = self._fs.makeQualified(self._path("")).toUri().getPath()
        while found.hasNext():
            path = found.next().getPath().toUri().getPath()
            if path.endswith(".parquet"):
                out.append(path[len(top) :].lstrip("/"))
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file whole under a new name; False if the name is taken. Readers never see a part of it."""
        final = self._path(name)
        if self._fs.exists(final):
            return False
        self._fs.mkdirs(final.getParent())
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.root.startswith("file:"):  # its rename would replace a file that another writer has just made
            at = unquote(urlparse(self.uri("")).path)
            try:
                os.link(f"{at}/{draft.getName()}" if "/" not in name else f"{at}/{os.path.dirname(name)}/{draft.getName()}", f"{at}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        if self._fs.rename(draft, final):
            return True
        self._fs.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def copy(self, name: str, to: Files) -> None:
        """A file, or a folder with all in it; what an earlier try may have left there goes first."""
        to.delete(name)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), to._fs, to._path(name), False, self._conf)
