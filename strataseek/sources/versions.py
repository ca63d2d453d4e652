"""A small state in numbered files, of which the last counts: a writer creates the next one, and fails if another was first."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from strataseek.sources.scratch import files_of


class Raced(RuntimeError):
    """Another writer was first; read the state again and repeat."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def last(self) -> tuple[int, dict | None]:
        """The last number and its state; 0 and none if there is none."""
        system, folder = files_of(self.spark, self.folder)
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return 0, None
        return number, json.loads(self.spark.read.text(f"{self.folder}/{number:08d}", wholetext=True).first()[0])

    def commit(self, number: int, state: dict) -> None:
        """Write the state of a number. A file is never replaced: of two writers the second has changed nothing."""
        system, target = files_of(self.spark, f"{self.folder}/{number:08d}")
        try:
            out = system.create(target, False)
        except Exception as e:
            if system.exists(target):
                raise Raced(f"version {number} of {self.folder} has been written by another") from e
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
