"""Versions of a folder of tables: what makes a change of several tables visible at once.

Tables are written to folders of their own under ``tables``.  A version is a small JSON file that
names the folder of each table; it is written under another name and then renamed, which
succeeds or fails as a whole, and never over an existing one.  Readers take the version with the
greatest number and keep to it.  A crash at any step leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

from tributary.sources.readers import exists, listing, remove


class VersionError(RuntimeError):
    """No version, or one that another writer published first."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/versions"):
            return []
        return sorted(int(n.removesuffix(".json")) for n, folder in listing(self.spark, f"{self.path}/versions") if not folder and n.endswith(".json") and n[0].isdigit())

    def tables(self, number: int) -> dict[str, str]:
        """The folder of each table in a version."""
        text = self.spark.read.text(f"{self.path}/versions/{number:08d}.json", wholetext=True).first()[0]
        return {name: f"{self.path}/{place}" for name, place in json.loads(text).items()}

    def new_folder(self, name: str) -> str:
        return f"{self.path}/tables/{name}-{uuid.uuid4().hex}"

    def publish(self, tables: Mapping[str, str], after: int) -> int:
        """Make these folders the version that follows ``after`` (0: the first); fails if there is one already."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = fs_path(f"{self.path}/versions/_draft-{uuid.uuid4().hex}"), fs_path(f"{self.path}/versions/{after + 1:08d}.json")
        fs = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({n: p.removeprefix(f"{self.path}/") for n, p in tables.items()}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise VersionError(f"{self.path}: version {after + 1} was published by another writer")
        return after + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last versions, and the folders that none of these names; nobody may read or write meanwhile."""
        numbers = self.numbers()
        if not numbers:
            return []
        for n in numbers[:-keep]:
            remove(self.spark, f"{self.path}/versions/{n:08d}.json")
        used = {p for n in numbers[-keep:] for p in self.tables(n).values()}
        gone = [p for n, _ in listing(self.spark, f"{self.path}/tables") if (p := f"{self.path}/tables/{n}") not in used]
        for p in gone:
            remove(self.spark, p)
        return gone
