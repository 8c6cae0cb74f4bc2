"""A table in numbered versions that several writers may change at once: optimistic, nothing is lost.

A version is a folder of Parquet and a mark ``_versions/<number>`` that names it. A writer reads the current version, writes what it makes of it
beside, and claims the next number by creating its mark, which only one can. Who comes second finds the mark there, and makes its change
again from the version that won. Readers see whole versions; older ones stay until they are dropped, the first among them as a backup.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sinks import _fs


class Conflict(Exception):
    """Other writers were faster, each time."""


@dataclass(frozen=True)
class Versioned:
    path: str

    def numbers(self, spark: SparkSession) -> list[int]:
        """The versions that there are, ascending."""
        fs, at = _fs(spark, f"{self.path}/_versions")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []

    def folder(self, spark: SparkSession, number: int) -> str:
        return f"{self.path}/{spark.read.text(f'{self.path}/_versions/{number:012d}').first()['value']}"

    def read(self, spark: SparkSession, number: int | None = None) -> DataFrame | None:
        """A version, the latest if none is named; None where there is none."""
        there = self.numbers(spark)
        if not there:
            return None
        return spark.read.parquet(self.folder(spark, there[-1] if number is None else number))

    def update(self, spark: SparkSession, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
        """Publishes ``change`` of the current version as the next one; gives its number. ``change`` is called again when another writer came first, so
        it must follow from its argument alone."""
        for _ in range(tries):
            there = self.numbers(spark)
            now = there[-1] if there else 0
            name = f"data-{uuid.uuid4().hex}"
            change(self.read(spark, now) if now else None).write.parquet(f"{self.path}/{name}")
            if self.claimed(spark, now + 1, name):
                return now + 1
            fs, lost = _fs(spark, f"{self.path}/{name}")
            fs.delete(lost, True)
        raise Conflict(f"{self.path}: {tries} tries")

    def claimed(self, spark: SparkSession, number: int, name: str) -> bool:
        """Creates the mark of a version, if nobody has: whole under another name first, then linked (local files) or, as the store creates a file
        only once, written."""
        jvm, (fs, at) = spark._jvm, _fs(spark, f"{self.path}/_versions/{number:012d}")
        fs.mkdirs(at.getParent())
        local = fs.getScheme() == "file"
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/_{uuid.uuid4().hex}") if local else at
        try:
            out = fs.create(mark, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(name.encode())
        out.close()
        if not local:
            return True
        to = jvm.java.nio.file.Paths.get(fs.makeQualified(at).toUri())
        try:
            jvm.java.nio.file.Files.createLink(to, jvm.java.nio.file.Paths.get(fs.makeQualified(mark).toUri()))
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(mark, False)

    def drop_before(self, spark: SparkSession, number: int, keep_first: bool = True) -> int:
        """Deletes older versions than ``number``, the first one excepted; gives how many."""
        gone = [n for n in self.numbers(spark) if n < number and not (keep_first and n == 1)]
        for n in gone:
            fs, folder = _fs(spark, self.folder(spark, n))
            fs.delete(_fs(spark, f"{self.path}/_versions/{n:012d}")[1], False)
            fs.delete(folder, True)
        return len(gone)
