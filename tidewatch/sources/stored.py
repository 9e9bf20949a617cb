"""Tables made once and kept in the checkpoint folder for as long as the files they were made from stay as they are."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import checkpointed

#: At most this many tables are kept, the least recently used go first.
KEPT = 16
_TABLES: OrderedDict[tuple, DataFrame] = OrderedDict()


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of change of each file under a path, by the file system that holds it; empty for none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ()
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of these inputs: built and written on first use, read on later ones, built anew when a file has changed."""
    key = (spark.sparkContext.applicationId, name, *(fingerprint(spark, p) for p in inputs))
    if key not in _TABLES:
        _TABLES[key] = checkpointed(build())
        while len(_TABLES) > KEPT:
            _TABLES.popitem(last=False)
    _TABLES.move_to_end(key)
    return _TABLES[key]


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty one of ``schema`` where nothing is stored."""
    return spark.read.parquet(path) if fingerprint(spark, path) else spark.createDataFrame([], schema)
