"""Tables whose parts are replaced all together or not at all.

A table is a folder of commits (files of the rows that a commit wrote, by part), of manifests (which commit holds each
part), and of pointers, one small file for each version that names its manifest and carries a ledger, such as the last
batch of a stream.  A version comes into being when its pointer file is created, which succeeds for one writer only, so
readers see the whole of a replacement or none of it, and of two writers that began at the same version the second gets
a Conflict.  What a failed or beaten writer has written is in no manifest and is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has made the next version."""


class VersionedTable:
    """part: the column by whose values rows are replaced; it should have few values beside the rows, such as projects or buckets."""

    def __init__(self, spark: SparkSession, path: str, part: str) -> None:
        self.spark, self.path, self.part = spark, path, part
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def version(self) -> int:
        """The newest version's number, 0 of a table without any."""
        if not self.files.exists(self._at("versions")):
            return 0
        return max((int(s.getPath().getName()) for s in self.files.listStatus(self._at("versions")) if s.getPath().getName().isdigit()), default=0)

    def _pointer(self, version: int) -> dict:
        stream = self.files.open(self._at("versions", f"{version:012d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def ledger(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self._pointer(version)["ledger"] if version else {}

    def _manifest(self, version: int) -> DataFrame | None:
        """part__ (as text), commit."""
        return self.spark.read.parquet(f"{self.path}/manifests/{self._pointer(version)['manifest']}") if version else None

    def read(self, version: int | None = None, parts: DataFrame | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is given; None of a table without any.  ``parts``: only these, a column of them."""
        version = self.version() if version is None else version
        manifest = self._manifest(version)
        if manifest is None:
            return None
        kind = self._pointer(version)["schema"]
        if parts is not None:
            manifest = manifest.join(parts.select(F.col(self.part).cast("string").alias("part__")).distinct(), "part__", "left_semi")
        commits = sorted(r["commit"] for r in manifest.select("commit").distinct().collect())
        if not commits:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(f"{kind}, part__ string, commit string").option("basePath", f"{self.path}/commits").parquet(*[f"{self.path}/commits/commit={c}" for c in commits])
        return rows.join(manifest, ["part__", "commit"], "left_semi").drop("part__", "commit")

    def stage(self, rows: DataFrame) -> str:
        """Writes rows beside the table and returns the commit's name."""
        commit = uuid.uuid4().hex
        rows.withColumn("part__", F.col(self.part).cast("string")).write.partitionBy("part__").parquet(f"{self.path}/commits/commit={commit}")
        return commit

    def replace(self, rows: DataFrame, gone: DataFrame | None = None, ledger: dict | None = None, expected: int | None = None, check=None) -> int:
        """Replaces the parts that ``rows`` have, and drops those in ``gone``; returns the new version.

        ``expected`` is the version that ``rows`` were made from (the newest if not given).  ``check`` is called with the staged
        rows and may raise.
        """
        expected = self.version() if expected is None else expected
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        commit = self.stage(rows)
        where = f"{self.path}/commits/commit={commit}"
        staged = self.spark.read.schema(f"{kind}, part__ string").parquet(where)
        if check:
            check(staged.drop("part__"))
        new = staged.select("part__").distinct().withColumn("commit", F.lit(commit))
        old = self._manifest(expected)
        if old is not None:
            left = old.join(new.select("part__"), "part__", "left_anti")
            if gone is not None:
                left = left.join(gone.select(F.col(self.part).cast("string").alias("part__")).distinct(), "part__", "left_anti")
            new = left.unionByName(new)
        manifest = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/manifests/{manifest}")
        return self._swap(expected, {"manifest": manifest, "schema": kind, "ledger": {**self.ledger(expected), **(ledger or {})}})

    def _swap(self, expected: int, pointer: dict) -> int:
        """Creates the next version's pointer, which must not be there."""
        at = self._at("versions", f"{expected + 1:012d}")
        try:
            stream = self.files.create(at, False)
        except Exception as e:
            if self.files.exists(at):
                raise Conflict(f"version {expected + 1} of {self.path} exists") from e
            raise
        try:
            stream.write(bytearray(json.dumps(pointer).encode()))
        finally:
            stream.close()
        return expected + 1

    def stale(self, keep: int = 1) -> list[str]:
        """Commits that none of the newest ``keep`` versions reads; what writers at work have staged is among them."""
        newest, live = self.version(), set()
        for v in range(max(1, newest - keep + 1), newest + 1):
            live |= {r["commit"] for r in self._manifest(v).select("commit").distinct().collect()}
        every = [s.getPath().getName().removeprefix("commit=") for s in self.files.listStatus(self._at("commits"))] if self.files.exists(self._at("commits")) else []
        return sorted(set(every) - live)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes them; for times without writers.  Older versions can't be read afterwards."""
        gone = self.stale(keep)
        for c in gone:
            self.files.delete(self._at("commits", f"commit={c}"), True)
        return len(gone)
