"""Tables between stages, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

_written: WeakKeyDictionary[DataFrame, tuple] = WeakKeyDictionary()
_left: list[tuple] = []
#: rows of a few numbers that a task of a last stage may well get; tasks below which stages aren't merged
TASK_ROWS, LEAST_TASKS = 100_000, 12


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows by ``keys`` into as many partitions as shuffles have.

    For rows that are few bytes but much work: partitions of a stated number aren't
    merged by their size, and windows and groups by the keys need no further exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def saved(df: DataFrame, codec: str | None = None, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the folder of ``spark.checkpoint.dir`` and read it.

    Unlike a checkpoint, a table has statistics, so that small ones are broadcast.
    Where the setting is missing a temporary folder is used in local mode only
    (tests); a cluster must name a folder that all its machines share. The tables go
    when Python ends.

    ``rows`` says about how many rows the last stage meets, where each is a few numbers
    and little work: no more tasks and files than these are worth, since every task and
    every file costs the same however little is in it.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, rows // TASK_ROWS))
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    _left.append((context, path))
    df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = (context, path)
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` returned, once all that still runs reads other saved tables in their place."""
    for table in tables:
        _delete(*_written.pop(table))


def _delete(context, path: str) -> None:
    if context._jsc is not None and (context, path) in _left:
        _left.remove((context, path))
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _clean() -> None:
    for context, path in list(_left):
        _delete(context, path)
