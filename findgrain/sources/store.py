"""A folder on any file system that Spark can write to."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """Small files and names below one URI. Tables below it are written by Spark itself."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self._path_of = jvm.org.apache.hadoop.fs.Path
        # a path without a scheme is one of the default file system, as for every table that Spark reads or writes
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path_of(uri).getFileSystem(conf)
        self.uri = self._fs.makeQualified(self._path_of(uri)).toString().rstrip("/")
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = jvm.org.apache.commons.io.IOUtils
        self._rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")

    def at(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def path(self, name: str = ""):
        return self._path_of(self.at(name) if name else self.uri)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(name)))

    def create(self, name: str) -> bool:
        """Makes an empty file; False where it was there already."""
        self._fs.mkdirs(self.path(name).getParent())
        try:
            return bool(self._fs.createNewFile(self.path(name)))
        except Exception:
            if self.exists(name):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def read_json(self, name: str) -> dict | None:
        """None for a file that is missing or cannot be read."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(self._io.toString(stream, self._utf8))
        except ValueError:
            return None
        finally:
            stream.close()

    def hash_bytes(self) -> str:
        """``hex(xxhash64(content))`` of the file that the URI names, read in pieces by the driver's JVM."""
        jvm = self.spark.sparkContext._jvm
        made = jvm.net.jpountz.xxhash.XXHashFactory.fastestInstance().newStreamingHash64(42)
        stream = jvm.java.util.zip.CheckedInputStream(self._fs.open(self.path()), made.asChecksum())
        try:
            self._io.consume(stream)
        finally:
            stream.close()
        return format(made.getValue() & (1 << 64) - 1, "X")

    def _put(self, name: str, value: dict, rename) -> None:
        new = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(new), True)
        stream.write(json.dumps(value).encode())
        stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        options[0] = rename
        try:
            context.rename(self.path(new), self.path(name), options)
        except Exception:
            self._fs.delete(self.path(new), False)
            raise

    def write_json(self, name: str, value: dict) -> None:
        """Replaces a file whole: readers see the old one or the new one."""
        self._put(name, value, self._rename.OVERWRITE)

    def create_json(self, name: str, value: dict) -> bool:
        """Makes a file with its content at once; False where it was there already."""
        if self.exists(name):
            return False
        try:
            self._put(name, value, self._rename.NONE)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True
