"""The ledger of a run: which of its steps were done to their end, in which generation, and what they took.

Each step is a table. It is entered when it was written: the entry is a small file that takes its name by a rename, so it is
there whole or not at all. A run that died goes on from its entries; a forced one begins a new generation and leaves the old
tables where they are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

FIRST = "initial"


class Ledger:
    """The ledger at a path. key: what the run's results hang on; going on with another one is an error."""

    def __init__(self, spark: SparkSession, path: str, key: str, resume: bool = False, force: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        begun = [e for e in self.entries() if e["step"] == "begin"]
        last = max(begun, key=lambda e: e["at"], default=None)
        if last and not (resume or force):
            raise FileExistsError(f"a run at {self.path} already exists")
        if last and resume and not force and last["key"] != key:
            raise ValueError(f"the run at {self.path} was begun with other settings")
        self.generation = last["generation"] if last and not force else uuid.uuid4().hex if last else FIRST
        if not last or force:
            self.enter("begin", key=key)
        self.done = {e["step"] for e in self.entries() if e["generation"] == self.generation}

    def folder(self, name: str) -> str:
        """A step's folder; the first generation's are the run's own."""
        return f"{self.path}/{name}" if self.generation == FIRST else f"{self.path}/{self.generation}/{name}"

    def enter(self, step: str, **more) -> None:
        entry = {"step": step, "generation": self.generation, "at": datetime.now(UTC).isoformat()} | more
        name, pending = (self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/{p}{self.generation}-{step.replace('/', '.')}.json") for p in ("", "_"))
        out = self.fs.create(pending, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self.fs.delete(name, False)
        if not self.fs.rename(pending, name):
            raise OSError(f"no entry for {step} at {self.path}")

    def entries(self) -> list[dict]:
        """All entries; a handful, in no order."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        if not self.fs.exists(where):
            return []
        rows = self.spark.read.schema("value string").text(f"{self.path}/ledger").collect()
        return [json.loads(r.value) for r in rows]

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step: what was written, or what make gives, written now."""
        return self.run(name, lambda: make().write.mode("overwrite").parquet(self.folder(name)), lambda: self.spark.read.parquet(self.folder(name)))

    def run(self, name: str, do: Callable[[], object], read: Callable[[], DataFrame]) -> DataFrame:
        """Does a step unless it was done, and reads what came of it."""
        if name not in self.done:
            start = time.monotonic()
            do()
            self.enter(name, seconds=round(time.monotonic() - start, 3))
            self.done.add(name)
        return read()

    def progress(self, steps: list[str]) -> list[tuple[str, str, int, int]]:
        """step, when it ended, how many were done by then, and of how many; in the order in which they ended."""
        own = sorted((e for e in self.entries() if e["generation"] == self.generation and e["step"] in steps), key=lambda e: e["at"])
        return [(e["step"], e["at"], k + 1, len(steps)) for k, e in enumerate(own)]
