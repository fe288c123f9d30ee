"""Versions of a table on shared storage, committed by renaming manifests.

A run writes into a folder of its own below ``data`` and counts from the moment
its manifest, an empty file of the run's name, gets its final name by a rename.
Readers follow the manifests, so the remains of a run that died are never read.
An ``all-`` run stands for every run of a smaller number.  One writer at a time;
what reaches the driver is one name per run since the last ``all-`` run, and the
names of those before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def runs(self, before: int | None = None) -> list[str]:
        """Names of the runs that count, oldest first, or did when the run of
        number ``before`` was next."""
        fs, p = self._fs(f"{self.folder}/manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        if before is not None:
            names = [n for n in names if n.startswith(("run-", "all-")) and number(n) < before + n.startswith("all-")]
        whole = max((n for n in names if n.startswith("all-")), default=None)
        first = number(whole) if whole else 0
        return ([whole] if whole else []) + [n for n in names if n.startswith("run-") and number(n) >= first]

    def next_number(self) -> int:
        return max((number(n) + n.startswith("run-") for n in self.runs()), default=0)

    def new(self, kind: str = "run") -> tuple[str, str]:
        """(name, folder) of a run to write; ``all`` for one that stands for all before it."""
        name = f"{kind}-{self.next_number():08d}-{uuid.uuid4().hex}"
        return name, f"{self.folder}/data/{name}"

    def paths(self, before: int | None = None) -> list[str]:
        return [f"{self.folder}/data/{n}" for n in self.runs(before)]

    def commit(self, name: str) -> None:
        fs, tmp = self._fs(f"{self.folder}/manifests/_tmp-{name}")
        fs.create(tmp, True).close()
        if not fs.rename(tmp, self._fs(f"{self.folder}/manifests/{name}")[1]):
            raise RuntimeError(f"manifest of {name} was not committed")


def number(name: str) -> int:
    return int(name.split("-")[1])
