"""Versioned tables with an atomically flipped pointer, a metadata sidecar and a writer's lock."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.governance import Busy


class VersionedStore:
    """``root/<version>/<table>`` Parquet directories; ``CURRENT`` names the version that readers see.

    A pass writes every table of a new version and then replaces the pointer, so a reader sees all of a pass or nothing
    of it, and a pass that dies leaves the version before in place.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @property
    def version(self) -> int:
        try:
            return int((self.root / "CURRENT").read_text())
        except FileNotFoundError:
            return 0

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(str(self.root / str(self.version) / table))

    def meta(self) -> dict:
        try:
            return json.loads((self.root / str(self.version) / "meta.json").read_text())
        except FileNotFoundError:
            return {}

    def commit(self, tables: dict[str, DataFrame], **meta: object) -> int:
        """Writes the next version and makes it current; its revision is one more than the last."""
        new = self.version + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(self.root / str(new) / name))
        record = self.meta() | meta | {"revision": int(self.meta().get("revision", 0)) + 1, "committed_at": time.time()}
        (self.root / str(new)).mkdir(exist_ok=True)
        (self.root / str(new) / "meta.json").write_text(json.dumps(record, sort_keys=True))
        pointer = self.root / "CURRENT.new"
        pointer.write_text(str(new))
        os.replace(pointer, self.root / "CURRENT")
        return new

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """One writer at a time; a second one is told so at once."""
        lock = self.root / "LOCK"
        try:
            fd = os.open(lock, os.O_CREAT | os.O_EXCL)
        except FileExistsError as e:
            raise Busy("another pass is writing") from e
        try:
            yield
        finally:
            os.close(fd)
            lock.unlink()
