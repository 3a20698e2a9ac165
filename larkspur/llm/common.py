"""Helpers shared by the training-data operators: tables, shared storage and memo tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader (the folder can be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (tests) a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = _own_dir(spark)
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
    spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/larkspur/{what}-{uuid.uuid4().hex}"


def free_name(columns: list[str], name: str) -> str:
    """A column name that a table does not have yet."""
    while name in columns:
        name += "_"
    return name


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and the
    files outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to the shared folder by one operator, which drops each when those that were made from
    it are written too."""

    def __init__(self):
        self._held: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, what: str) -> DataFrame:
        """As ``materialise``."""
        path = new_path(df.sparkSession, what)
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self._held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for out, path in self._held:
            if any(out is t for t in tables):
                where = out.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(out.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self._held = [(out, path) for out, path in self._held if not any(out is t for t in tables)]


class Files:
    """Whole-file access to the shared folder from Python, on a local path or any pyarrow store."""

    def __init__(self, root: str):
        url = urlparse(root)
        self.local = url.scheme in ("", "file")
        self.root = url.path if self.local else root

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, name: str, chunks) -> None:
        """All chunks, then one atomic rename, so that a task that runs twice leaves one whole file."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            with open(f"{self.root}/{part}", "wb") as out:
                for chunk in chunks:
                    out.write(chunk)
            os.replace(f"{self.root}/{part}", f"{self.root}/{name}")
            return
        store, base = self._fs()
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{part}") as out:
            for chunk in chunks:
                out.write(chunk)
        store.move(f"{base}/{part}", f"{base}/{name}")

    def open(self, name: str):
        if self.local:
            return open(f"{self.root}/{name}", "rb")
        store, base = self._fs()
        return store.open_input_stream(f"{base}/{name}")

    def array(self, name: str, dtype):
        """The flat array in a file: memory-mapped where the store is a local path."""
        import numpy as np

        if self.local:
            path = f"{self.root}/{name}"
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        with self.open(name) as f:
            return np.frombuffer(f.read(), dtype)


_KEPT: list = []


def worker_cache(maxsize: int):
    """An ``lru_cache`` for what a worker process keeps from task to task, which ``let_go`` can empty."""

    def wrap(function):
        cached = lru_cache(maxsize=maxsize)(function)
        _KEPT.append(cached)
        return cached

    return wrap


def let_go(*but) -> None:
    """Called where a task begins: the process drops what other operators kept for their tasks, all caches but
    those named.  Spark's workers live on from stage to stage, and would hold the tables of all operators."""
    old = [cached for cached in _KEPT if cached not in but and cached.cache_info().currsize]
    for cached in old:
        cached.cache_clear()
    if old:
        gc.collect()  # memo tables call methods of the object that holds them
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: the allocators of Arrow and of C keep what large batches took, stage after stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def each(column):
    """The values of an Arrow array one at a time, so that no second copy of a whole batch of texts is held."""
    return (x.as_py() for x in column)


class Memo(dict):
    """A bounded memo table of a pure function: at ``cap`` entries the table becomes the old
    generation, and entries that are still asked for move up again.  Keys of more than ``LONGEST``
    characters are not kept (texts without spaces are one key), so the cap bounds the bytes too."""

    LONGEST = 64

    def __init__(self, function, cap: int = 300_000):
        super().__init__()
        self.function, self.cap, self.old = function, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self.add(key, value)
        return value

    def known(self, key):
        """The remembered value, or None."""
        value = self.get(key)
        return self.old.get(key) if value is None else value

    def add(self, key, value) -> None:
        if isinstance(key, str | bytes) and len(key) > self.LONGEST:
            return
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
