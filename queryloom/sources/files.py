"""Small documents that are replaced as a whole, on a local or any Hadoop file system."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from queryloom.errors import ExecutionError

KEEP = 8


class Conflict(ExecutionError):
    """Somebody else replaced the document first."""


class Document:
    """A text whose versions are files <path>.<number>; the highest number counts.

    A new version is written aside and renamed to the next number, which fails where
    that number is taken: of two writers who read the same version one gets a
    ``Conflict`` and nothing is lost. Without a session the path is local.
    """

    def __init__(self, path: str | Path, spark: SparkSession | None = None) -> None:
        self.path, self.spark = str(path), spark
        self.folder, _, self.name = self.path.rpartition("/")
        self._number = re.compile(re.escape(self.name) + r"\.(\d{12})")

    def _at(self, path: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self) -> Any:
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, version: int) -> str:
        return f"{self.path}.{version:012d}"

    def _versions(self) -> list[int]:
        if self.spark is None:
            names = os.listdir(self.folder or ".") if os.path.isdir(self.folder or ".") else []
        else:
            fs, folder = self._fs(), self._at(self.path).getParent()
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := self._number.fullmatch(n)))

    def load(self) -> tuple[int, str | None]:
        """The version there is (0: none yet) and its text."""
        found = self._versions()
        if not found:
            return 0, None
        if self.spark is None:
            return found[-1], Path(self._file(found[-1])).read_text(encoding="utf-8")
        stream = self._fs().open(self._at(self._file(found[-1])))
        try:
            return found[-1], bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> str | None:
        return self.load()[1]

    def commit(self, text: str, version: int) -> None:
        """Make text the version behind ``version``, or raise Conflict."""
        aside, target = f"{self.folder or '.'}/.{self.name}-{uuid.uuid4().hex}", self._file(version + 1)
        if self.spark is None:
            Path(aside).parent.mkdir(parents=True, exist_ok=True)
            Path(aside).write_text(text, encoding="utf-8")
            try:
                os.link(aside, target)
            except FileExistsError:
                raise Conflict(f"{self.path} was replaced by another writer.") from None
            finally:
                os.unlink(aside)
        else:
            self._rename(text, aside, target)
        for old in self._versions()[:-KEEP]:
            if self.spark is None:
                Path(self._file(old)).unlink(missing_ok=True)
            else:
                self._fs().delete(self._at(self._file(old)), False)

    def _rename(self, text: str, aside: str, target: str) -> None:
        jvm, fs = self.spark._jvm, self._fs()
        out = fs.create(self._at(aside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(self._at(aside)), fs.makeQualified(self._at(target)), options)
        except Exception as e:
            fs.delete(self._at(aside), False)
            if fs.exists(self._at(target)):
                raise Conflict(f"{self.path} was replaced by another writer.") from None
            raise ExecutionError(f"Cannot replace {self.path}: {e}") from e

    def replace(self, text: str) -> None:
        """Make text the newest version, whatever there was."""
        while True:
            try:
                return self.commit(text, self.load()[0])
            except Conflict:
                continue
