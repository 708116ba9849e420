"""Tables that are replaced or added to as one: generations below a manifest that is written last.

A folder holds generations, each a folder of its own with Parquet tables, and manifests with
rising numbers. A manifest names the generations that count. It is written to a file of another name
and renamed, and a rename to a name that is taken fails, so a reader sees the old state
or the new one, a writer that is killed leaves the old one, and of two writers one fails.
Generations that neither the newest manifest nor the one before it names are deleted on the next
commit: a reader that still has the older one goes on.

A manifest also keeps a key: what the tables were made from and how. source_key() makes one of any
settings and of the files that a table is read from, with their sizes and times, so a cache whose
source changed is not found.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


def source_key(settings: object, *frames: DataFrame) -> str:
    """A key of settings and of the files that frames are read from: paths, lengths and times of change."""
    known = [repr(settings)]
    for df in frames:
        for name in sorted(df.inputFiles()):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            file = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(path)
            known.append(f"{name} {file.getLen()} {file.getModificationTime()}")
    return hashlib.sha256("\n".join(known).encode()).hexdigest()


class Generations:
    """The generations below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, prefix: str) -> list[str]:
        fs, path = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith(prefix)) if fs.exists(path) else []

    def _manifest(self, name: str) -> dict:
        fs, path = self._fs(f"{self.root}/{name}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict:
        """{"number", "generations", "key"} of the newest manifest; number 0 and nothing before the first."""
        names = self._names("manifest-")
        return self._manifest(names[-1]) if names else {"number": 0, "generations": [], "key": None}

    def new(self) -> str:
        """The name of a generation that doesn't count yet; its tables are written below path(name, table)."""
        return f"gen-{uuid.uuid4().hex}"

    def path(self, generation: str, table: str) -> str:
        return f"{self.root}/{generation}/{table}"

    def drop(self, generation: str, table: str) -> None:
        """Delete a table that was written on the way to others."""
        fs, path = self._fs(self.path(generation, table))
        fs.delete(path, True)

    def commit(self, generations: list[str], key: str | None = None, after: int | None = None) -> int:
        """Make these the generations that count; ``after`` is the number of the manifest they follow on."""
        before = self.current()
        number = (before["number"] if after is None else after) + 1
        if before["number"] >= number:
            raise Conflict(f"{self.root} has manifest {before['number']} already")
        text = json.dumps({"number": number, "generations": generations, "key": key})
        fs, draft = self._fs(f"{self.root}/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        _, place = self._fs(f"{self.root}/manifest-{number:012d}")
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(f"{self.root} has manifest {number} already")
        needed = {*generations, *before["generations"]}
        for name in self._names("gen-"):
            if name not in needed:
                fs.delete(self._fs(f"{self.root}/{name}")[1], True)
        for name in self._names("manifest-")[:-2]:
            fs.delete(self._fs(f"{self.root}/{name}")[1], False)
        return number

    def save(self, tables: Mapping[str, DataFrame], key: str | None = None) -> None:
        """Replace all tables at once."""
        after, made = self.current()["number"], self.new()
        for name, df in tables.items():
            df.write.parquet(self.path(made, name))
        self.commit([made], key, after)

    def load(self, schemas: Mapping[str, str], key: str | None = None) -> dict[str, DataFrame] | None:
        """The tables that were saved last; None if there are none, they have another key, or one lacks a column."""
        now = self.current()
        if not now["generations"] or (key is not None and now["key"] != key):
            return None
        out = {}
        for name, schema in schemas.items():
            wanted = {c.split()[0] for c in schema.split(", ")}
            fs, path = self._fs(self.path(now["generations"][-1], name))
            if not fs.exists(path):
                return None
            df = self.spark.read.parquet(self.path(now["generations"][-1], name))
            if not wanted <= set(df.columns):
                return None
            out[name] = df
        return out
