"""Intermediate tables in the cluster's shared folder.

A fit needs earlier results as tables of known size, with their lineage cut.
They are written once, under the folder named by ``spark.checkpoint.dir``, so
they outlive any executor. Row count and size are observed during the write
itself; no second job counts them. The setting is trusted to name a folder that all
executors reach. What a process has not dropped by its end is deleted then.
"""

from __future__ import annotations

import atexit
import copy
import gc
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
BROADCAST_BYTES = 64 * 1024 * 1024

_local_folders: dict[str, str] = {}
_open: dict[str, Workspace] = {}
_of_session: dict[str, Workspace] = {}
_kept: dict[tuple, tuple[tuple, Stored]] = {}


@dataclass(frozen=True)
class Stored:
    """A written table, with its exact row count and uncompressed size."""

    df: DataFrame
    path: str
    rows: int
    bytes: int

    def fits(self, limit: int) -> bool:
        return self.bytes <= limit


class Workspace:
    """A folder for the tables of one run."""

    def __init__(self, spark: SparkSession, broadcast_bytes: int = BROADCAST_BYTES):
        self.spark = spark
        self.broadcast_bytes = broadcast_bytes
        self.root = f"{_shared_folder(spark)}/effectspark-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)
        _open[self.root] = self

    def limited(self, broadcast_bytes: int) -> Workspace:
        """The same folder with another broadcast limit."""
        other = copy.copy(self)
        other.broadcast_bytes = broadcast_bytes
        return other

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self._numbers):03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> Stored:
        """Write ``df`` and read it back with a known size and no lineage."""
        path = self.path(name)
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        text_bytes = [F.sum(F.octet_length(c)).alias(f"bytes_{i}") for i, c in enumerate(texts)]
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *text_bytes)
        watched.write.partitionBy(*partition_by).parquet(path)
        rows = int(seen.get["rows"])
        size = sum(int(seen.get[f"bytes_{i}"] or 0) for i in range(len(texts)))
        size += rows * 8 * (len(df.columns) + 1)
        return Stored(self.read(path, df.schema), path, rows, size)

    @contextmanager
    def saving(self, df: DataFrame | None, name: str) -> Iterator[Callable[[], Stored | None]]:
        """Save in the background; the yielded function waits for the table.

        For a pass that does not depend on the ones that follow: its tasks fill
        the cores that the tails of their stages leave idle.
        """
        with ThreadPoolExecutor(1) as pool:
            if df is None:
                yield lambda: None
            else:
                task = inheritable_thread_target(self.spark)(lambda: self.save(df, name))
                yield pool.submit(task).result

    def read(self, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
        paths = [path] if isinstance(path, str) else list(path)
        return self.spark.read.schema(schema).parquet(*paths)

    def small(self, table: Stored) -> DataFrame:
        """The table, marked for broadcast only if its measured size allows it."""
        return F.broadcast(table.df) if table.fits(self.broadcast_bytes) else table.df

    def kept(self, name: str, about: tuple, inputs: Sequence[str], make: Callable[[], Stored]) -> Stored:
        """A table that queries of one session share: made once for the same name and unchanged input files.

        After a change the old copy is deleted, so that a result still to be computed from
        it fails instead of mixing old rows with new ones.
        """
        key, now = (self.root, name, *about), self.fingerprint(inputs)
        seen, found = _kept.get(key, (None, None))
        if found is not None and seen != now:
            self.delete(found.path)
        if seen != now or not self.exists(found.path):
            found = make()
            _kept[key] = (now, found)
        return found

    def fingerprint(self, paths: Sequence[str]) -> tuple:
        """One value for names, lengths and modification times of all files below ``paths``; no content is read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
        about = F.xxhash64("path", "length", "modificationTime")
        row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(about), F.sum(F.pmod(about, F.lit(1 << 30)))).first()
        return tuple(row)

    def size(self, paths: Sequence[str]) -> int:
        """Bytes of all files below the ``paths`` that exist."""
        places = [self._place(p) for p in paths]
        return sum(store.getContentSummary(at).getLength() for store, at in places if store.exists(at))

    def delete(self, path: str) -> None:
        store, place = self._place(path)
        store.delete(place, True)

    def exists(self, path: str) -> bool:
        store, place = self._place(path)
        return store.exists(place)

    def forget_shuffles(self) -> None:
        """Have the files of shuffles that nothing refers to any more deleted now: Spark does so after the driver's garbage collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        """Delete this run's folder, once no DataFrame reads from it any more."""
        self.delete(self.root)
        _open.pop(self.root, None)

    def _place(self, path: str):
        return file_system(self.spark, path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()
    return place.getFileSystem(conf), place


def session_workspace(spark: SparkSession) -> Workspace:
    """The one folder that all registered queries of a session use."""
    app = spark.sparkContext.applicationId
    found = _of_session.get(app)
    if found is None or found.root not in _open:
        found = _of_session[app] = Workspace(spark)
    return found


@atexit.register
def _clean_up() -> None:
    """Delete what is left; at the end of a process its session may be gone already."""
    for workspace in list(_open.values()):
        with suppress(Exception):
            workspace.drop()
    for folder in _local_folders.values():
        shutil.rmtree(folder, ignore_errors=True)


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="effectspark-")
    return _local_folders[app]
