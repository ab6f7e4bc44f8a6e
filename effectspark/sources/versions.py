"""Versions of a set of tables, each committed by one small file written last.

Data is written under names that nobody else uses; a version exists from the moment its
manifest has its final name. So a reader sees a version whole or not at all, a writer
that dies leaves nothing but unread files, and of two writers of one number the second
fails. Manifests are renamed into place, which must not replace a file; stores without
such a rename need a single writer.
"""

from __future__ import annotations

import json
import uuid
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from effectspark.sources.store import file_system

_MANIFEST = "{}/manifests/{:020d}.json"


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    """The versions below one folder, by number."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def new_folder(self) -> str:
        """A place for data that no other writer uses."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        """The committed versions, oldest first."""
        store, folder = file_system(self.spark, f"{self.root}/manifests")
        if not store.exists(folder):
            return []
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def latest(self) -> int | None:
        return max(self.numbers(), default=None)

    def read(self, number: int) -> dict:
        path = _MANIFEST.format(self.root, number)
        return json.loads(self.spark.read.text(path, wholetext=True).first()["value"])

    def commit(self, number: int, about: dict) -> int:
        """Make the version visible; :class:`VersionTaken` if it already is."""
        store, target = file_system(self.spark, _MANIFEST.format(self.root, number))
        draft = file_system(self.spark, f"{self.root}/drafts/{uuid.uuid4().hex}")[1]
        out = store.create(draft, False)
        try:
            out.write(bytearray(json.dumps(about).encode()))
        finally:
            out.close()
        store.mkdirs(target.getParent())
        jvm = self.spark.sparkContext._jvm
        names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), store.getConf())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(kind, 1)
        none[0] = kind.NONE
        try:
            names.rename(draft, target, none)
        except Py4JJavaError as error:
            with suppress(Py4JJavaError):
                store.delete(draft, False)
            if store.exists(target):
                raise VersionTaken(f"version {number} of {self.root}") from error
            raise
        return number

    def commit_next(self, about: dict) -> int:
        """Commit under the least number that is free."""
        while True:
            last = self.latest()
            with suppress(VersionTaken):
                return self.commit(0 if last is None else last + 1, about)

    def forget(self, keep: int) -> None:
        """Delete all but the newest ``keep`` versions and the data that only those use.

        For times without a writer: data that is not committed yet goes too.
        """
        gone, kept = self.numbers()[:-keep], self.numbers()[-keep:]
        used = json.dumps([self.read(n) for n in kept])
        for n in gone:
            store, path = file_system(self.spark, _MANIFEST.format(self.root, n))
            store.delete(path, False)
        store, data = file_system(self.spark, f"{self.root}/data")
        for folder in store.listStatus(data) if store.exists(data) else []:
            if folder.getPath().getName() not in used:
                store.delete(folder.getPath(), True)
