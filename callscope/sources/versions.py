"""Committed versions of a folder: readers see one whole version, whatever is being written.

``<root>/_versions/<number>.json`` names what belongs to a version. A commit writes a new file and
renames it to the next number, which fails if another writer was faster; nothing that a version
names is changed afterwards, so a reader that has read the file finds all of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Versions that stay readable after newer ones were committed.
KEPT = 3


class Versions:
    """The versions of ``root``: ``current()`` reads the newest, ``commit`` adds the next."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions/{name}".rstrip("/"))

    def _fs(self):
        p = self._path()
        return p.getFileSystem(self.conf)

    def numbers(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(self._path())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"{number}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """(number, content) of the newest version; (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, content: dict, after: int) -> int:
        """Make ``content`` version ``after + 1``; an error if that number was taken meanwhile. Versions before the last ``KEPT`` go."""
        fs, fresh = self._fs(), self._path(f".{uuid.uuid4().hex}")
        stream = fs.create(fresh, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.conf)
        no_options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fresh, self._path(f"{after + 1}.json"), no_options)
        except Exception:
            fs.delete(fresh, False)
            raise
        for n in self.numbers():
            if n <= after + 1 - KEPT:
                fs.delete(self._path(f"{n}.json"), False)
        return after + 1

    def kept(self) -> list[dict]:
        """Contents of all versions that are still readable."""
        return [self.read(n) for n in self.numbers()]

    def delete(self, name: str) -> None:
        """Remove what no readable version names any more."""
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs().delete(p, True)
