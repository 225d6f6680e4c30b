"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: it sorts before every real id and comes back as null.
NULL_ID = -(2**63)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="queryloom-")) / "queryloom.zip"  # the driver serves it from here
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted((root / "queryloom").rglob("*.py")):
                z.write(path, path.relative_to(root))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a temporary one where nothing names any and all is one machine (tests)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("On a cluster spark.checkpoint.dir must name a shared folder.")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="queryloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions, for explicit repartitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, but at its end what it has freed goes back to the system.

    A Python worker lives through many tasks and stages, and allocators keep freed memory:
    without this it has at any time about the most that any stage before it has needed.
    """

    @wraps(f)
    def run(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        batches = f(*args, **kwargs)
        del args, kwargs
        yield from batches
        del batches
        give_back()

    return run


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def inner_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID).cast("long"))


def outer_id(name: str) -> Column:
    return F.when(F.col(name) != F.lit(NULL_ID).cast("long"), F.col(name))


#: Places of the bitmap of repeated ids; it has at most a 64th as many rows.
ID_BITS = 1 << 23


def row_tag(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """docs with ``_tag``, which tells rows of one id apart by their text: 0 where no other row has the id.

    Which ids are repeated is kept as a bitmap of ``ID_BITS`` hashed places, so what is
    broadcast has at most ``ID_BITS`` / 64 rows of 16 bytes, however many ids there are.
    An id that only shares its place with a repeated one gets a tag for nothing. Rows
    without an id always have one.
    """
    place = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(ID_BITS))
    twice = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").groupBy("id").count().where("count > 1")
    at = F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
    bits = checkpoint(twice.select(F.floor(at / 64).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    bit = F.call_function("shiftright", F.col("_bits"), F.pmod(F.col("_place"), F.lit(64)).cast("int")).bitwiseAND(1) == 1
    marked = docs.withColumn("_place", place).withColumn("_at", F.floor(F.col("_place") / 64)).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    tag = F.when(F.col(id_col).isNull() | F.coalesce(bit, F.lit(False)), F.xxhash64(text).bitwiseOR(1)).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("_tag", tag).drop("_place", "_at", "_word", "_bits")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, with null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]
