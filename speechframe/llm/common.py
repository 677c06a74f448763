"""Helpers shared by the operators: shared storage, Arrow row mapping, text bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    ``spark.checkpoint.dir`` names it on a cluster.  Where the setting is
    unset a local master gets a folder below the system temp folder; any other
    raises, as executors don't share such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints/speechframe"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, replicated checkpoint in the shared folder (never a local one)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one key that a join may leave together; keys that it looks at as hot.
PART_ROWS, HOT_KEYS = 65_536, 1000


def spread_join(big: DataFrame, small: DataFrame, key: str, n: str, row: list[str], how: str = "inner", counts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, where a key may hold any share of big's rows.

    ``small`` has one row a key, and in ``n`` the number of big's rows with it (n is dropped);
    ``counts`` (key, n) says the same where that is cheaper to read, as it is read first,
    unless big is known to have ``most`` rows, no more than may stay together.
    The HOT_KEYS most frequent keys of more than PART_ROWS rows, a list of bounded size
    whatever the input, are dealt to parts by a hash of ``row``, beside as many copies of
    small's row; any key outside it holds less than 1 / HOT_KEYS of the rows.  Rows
    of big without a key stay out of the shuffle.
    """
    counts = small if counts is None else counts
    hot = [] if most is not None and most <= PART_ROWS else counts.where(F.col(n) > PART_ROWS).orderBy(F.desc(n), key).limit(HOT_KEYS).select(key, n).collect()
    small = small.drop(n)
    some = big.where(F.col(key).isNotNull())
    if hot:
        parts = F.broadcast(big.sparkSession.createDataFrame([(r[0], -(-r[1] // PART_ROWS)) for r in hot], T.StructType([T.StructField("__hot", small.schema[key].dataType), T.StructField("__parts", T.IntegerType())])))
        number = F.coalesce("__parts", F.lit(1))
        left = some.join(parts, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(*row), number).cast("int")).drop("__hot", "__parts")
        right = small.join(parts, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), number - 1))).drop("__hot", "__parts")
        out = left.join(right, [key, "__part"], how).drop("__part")
    else:
        out = some.join(small, key, how)
    return out.unionByName(big.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextmanager
def open_output(uri: str):
    """Write ``uri`` atomically: bytes go to a side name that is renamed on success."""
    side = f"{uri}.{uuid.uuid4().hex}.part"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(_local(side), "wb") as f:
                yield f
            os.replace(_local(side), path)
        except BaseException:
            if os.path.exists(_local(side)):
                os.remove(_local(side))
            raise
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    _, part = fs.FileSystem.from_uri(side)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as f:
        yield f
    store.move(part, path)


def open_input(uri: str):
    """A seekable binary reader for ``uri``."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


#: Bytes of an Arrow batch on its way to Python, where the session doesn't set its own.
BATCH_BYTES = "8m"
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session sets a size: executor and worker each hold a batch or two, so its size is most of their need."""
    if spark.conf.get(_SETTING).rstrip("b") == str(_DEFAULT):
        spark.conf.set(_SETTING, BATCH_BYTES)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` in bounded batches; a task gives its Arrow memory back at its end."""
    bounded_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


def map_rows(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]], step: int = 1024) -> DataFrame:
    """``mapInArrow`` where ``make()`` is called once per task and returns a
    function from a record batch to the list of output columns (one Python list,
    numpy array or Arrow array per field of ``schema``).

    Batches are cut to ``step`` rows so that a task holds few texts at a time.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                columns = f(batch.slice(at, step))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == t.type else pa.array(c, type=t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return map_arrow(df, run, schema)


def schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(*x) for x in _parse(ddl)])


def _parse(ddl: str) -> list[tuple[str, T.DataType]]:
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "short": T.ShortType(),
        "ints": T.ArrayType(T.IntegerType()), "longs": T.ArrayType(T.LongType()), "strings": T.ArrayType(T.StringType()),
        "spans": T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
    }
    return [(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))]
