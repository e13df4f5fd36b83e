"""Tables that are rewritten while they are read.

A table is a root folder with data folders and manifests. A manifest is a small file
that lists the data folders of one state of the table; its number is its name. A
write first finishes its data folder and then renames a manifest into place, which is one
step on every Hadoop file system. A reader takes the newest manifest: it sees the state
before or after a write, never between. A write that fails leaves the old state and an
unlisted folder, which ``vacuum`` removes.

Two writers that start from the same state can't both take the next number: the
second one's rename fails, and it must read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def state(self, number: int | None = None) -> tuple[int, list[str]]:
        """Number and data folders of the newest state (or of ``number``); 0 and none
        before the first write."""
        numbers = self._numbers()
        if not numbers:
            return 0, []
        number = numbers[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.root}/manifests/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, [f"{self.root}/{name}" for name in text.split("\n") if name]

    def commit(self, folders: list[str], base: int) -> int:
        """Make ``folders`` the state after ``base``."""
        text = "\n".join(f.removeprefix(f"{self.root}/") for f in folders)
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self._path(f"{self.root}/manifests/{base + 1:012d}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise Conflict(f"state {base + 1} of {self.root} exists")
        return base + 1

    def new_folder(self) -> str:
        return f"{self.root}/data-{uuid.uuid4().hex}"

    def replace(self, write: Callable[[str], None]) -> int:
        """``write(folder)`` writes the whole table anew."""
        base, _ = self.state()
        folder = self.new_folder()
        write(folder)
        return self.commit([folder], base)

    def append(self, write: Callable[[str], None]) -> int:
        base, folders = self.state()
        folder = self.new_folder()
        write(folder)
        return self.commit([*folders, folder], base)

    def read(self, read: Callable[[list[str]], DataFrame], empty: str) -> DataFrame:
        """``read(folders)`` of the newest state, or an empty table of schema ``empty``."""
        _, folders = self.state()
        return read(folders) if folders else self.spark.createDataFrame([], empty)

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the newest ``keep``, and data that none of these lists.
        Readers of an older state, and writers at work, must have ended."""
        numbers = self._numbers()
        live = {f for n in numbers[-keep:] for f in self.state(n)[1]}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{n:012d}"), False)
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("data-") and f"{self.root}/{name}" not in live:
                self._fs.delete(status.getPath(), True)
