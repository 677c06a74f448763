"""Folders that driver and executors share, lineage cut there, and files that appear whole or not at all."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local master gets a folder of its own, any other raises, as its executors share none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints/streams"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``, the sum of ``value`` over the rows before each in ``order``: a range sort, sums of its partitions (a row each in one task), then sums inside partitions."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = parts.groupBy("__part").agg(F.sum(value).alias("__n")).select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__offset"))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return parts.withColumn(out, inside).join(before, "__part").withColumn(out, F.col(out) + F.col("__offset")).drop("__part", "__offset")


def local(uri: str) -> str | None:
    """The path of a URI on a mounted file system; None for another store's."""
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sizes(folder: str, suffix: str = "") -> dict[str, int]:
    """URI and size of every file in a folder; those whose names start with a dot aren't there yet."""
    if (path := local(folder)) is not None:
        found = [(e.name, e.stat().st_size) for e in os.scandir(path) if e.is_file()] if os.path.isdir(path) else []
    else:
        from pyarrow import fs

        store, path = _store(folder)
        found = [(i.base_name, i.size) for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.is_file]
    return {f"{folder.rstrip('/')}/{n}": s for n, s in sorted(found) if not n.startswith(".") and n.endswith(suffix)}


def open_input(uri: str):
    if (path := local(uri)) is not None:
        return open(path, "rb")
    store, path = _store(uri)
    return store.open_input_file(path)


def write_new(uri: str, content: bytes, settled: bool = True) -> None:
    """Writes a file, down to the disk unless ``settle`` follows, in a folder that is there."""
    if (path := local(uri)) is not None:
        with open(path, "wb") as f:
            f.write(content)
            if settled:
                f.flush()
                os.fsync(f.fileno())
    else:
        store, path = _store(uri)
        with store.open_output_stream(path) as f:
            f.write(content)


def settle(uri: str) -> None:
    """What was written near a URI is on the disk from here on, however many files it is; another store's files are when they are closed."""
    if local(uri) is not None:
        os.sync()


def make_folder(uri: str) -> None:
    if (path := local(uri)) is not None:
        os.makedirs(path, exist_ok=True)
    else:
        store, path = _store(uri)
        store.create_dir(path, recursive=True)


def remove_folder(uri: str) -> None:
    if (path := local(uri)) is not None:
        shutil.rmtree(path, ignore_errors=True)
    else:
        store, path = _store(uri)
        store.delete_dir(path, missing_dir_ok=True)


def rename(side: str, to: str) -> None:
    if local(side) is not None:
        os.replace(local(side), local(to))
    else:
        store, path = _store(side)
        store.move(path, _store(to)[1])


def write_whole(folder: str, name: str, content: bytes) -> None:
    """Replaces a file at once: readers see the old or the new one."""
    make_folder(folder)
    side = f"{folder.rstrip('/')}/.{name}.{uuid.uuid4().hex}"
    write_new(side, content)
    rename(side, f"{folder.rstrip('/')}/{name}")
